"""GA4 and native-protocol columns, from tables of parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.casts import CASTS, bankers_round, float_or_null
from ..operators.lookups import nested_lookup
from ..plans.columns import ColumnDef
from .requests import value
from .shared_columns import computed, gcs_flag, page_param, param, shared

#: Event parameters by prefix and cast (fixed values): column params_<name> comes from <prefix>.<name>.
EVENT_PARAMS = {
    ("ep", "str"): """content_group content_id content_type campaign campaign_id campaign_source campaign_medium campaign_content campaign_term coupon currency
        shipping_tier payment_type transaction_id item_list_id item_list_name creative_name creative_slot promotion_id promotion_name ad_event_id ad_unit_code
        reward_type video_provider video_title video_url link_classes link_domain link_id link_text link_url method cancellation_reason firebase_error
        firebase_error_value firebase_screen firebase_screen_class firebase_screen_id firebase_previous_screen firebase_previous_class firebase_previous_id
        message_id message_name message_type topic label app_version previous_app_version previous_os_version achievement_id character level_name
        virtual_currency_name item_name screen_resolution reset_analytics_cause previous_gmp_app_id file_extension file_name form_destination form_id form_name
        form_submit_text group_id language search_term unconvert_lead_reason disqualified_lead_reason lead_source lead_status product_id gclid dclid srsltid
        aclid anid ga_session_id""",
    ("ep", "int"): "exposure_time video_percent message_device_time message_time previous_first_open_count level",
    ("ep", "bool"): "outbound fatal updated_with_analytics success visible system_app system_app_update deferred_analytics_collection free_trial subscription",
    ("epn", "float"): "shipping tax value reward_value percent_scrolled price quantity introductory_price",
    ("epn", "int"): "video_current_time video_duration score ga_session_number renewal_count",
}

#: Two-letter codes of an item's parts: code -> field (fixed values).
ITEM_CODES = {
    "id": "item_id", "nm": "item_name", "af": "affiliation", "cp": "coupon", "ds": "discount", "lp": "index", "br": "item_brand", "ca": "item_category", "c2": "item_category2",
    "c3": "item_category3", "c4": "item_category4", "c5": "item_category5", "li": "item_list_id", "ln": "item_list_name", "va": "item_variant", "lo": "location_id", "pr": "price",
    "qt": "quantity", "cn": "creative_name", "cs": "creative_slot", "pi": "promotion_id", "pn": "promotion_name",
}
ITEM_NUMBERS = ("discount", "index", "price", "quantity")
#: Item fields that fall back to the event's parameter.
ITEM_FALLBACKS = ("item_list_id", "item_list_name", "creative_name", "creative_slot", "promotion_id", "promotion_name")


def params_array() -> Column:
    """name, value_string, value_number of every ep.* and numeric epn.* parameter, sorted by name."""
    entries = F.map_entries(F.map_filter(F.coalesce("query_params", F.expr("map()")), lambda k, _: k.startswith("ep.") | k.startswith("epn.")))

    def spread(e: Column) -> Column:
        number = e["key"].startswith("epn.")
        name = F.regexp_replace(e["key"], "^epn?\\.", "")
        return F.transform(e["value"], lambda v: F.struct(name.alias("name"), F.when(~number, v).alias("value_string"), F.when(number, float_or_null(v)).alias("value_number")))

    rows = F.filter(F.flatten(F.transform(entries, spread)), lambda r: r["value_string"].isNotNull() | r["value_number"].isNotNull())
    return F.array_sort(rows)


#: Item fields in the order of the stored array (fixed values).
ITEM_FIELDS = (
    "item_id item_name affiliation coupon discount index item_brand item_category item_category2 item_category3 item_category4 item_category5 item_list_id item_list_name item_variant location_id "
    "price price_in_usd quantity item_refund item_refund_in_usd item_revenue item_revenue_in_usd promotion_id promotion_name creative_name creative_slot"
).split()
ITEM_DOUBLES = {"discount", "index", "price", "price_in_usd", "quantity", "item_refund", "item_refund_in_usd", "item_revenue", "item_revenue_in_usd"}
ITEM_TYPE = "struct<" + ",".join(f"{n}:{'double' if n in ITEM_DOUBLES else 'string'}" for n in ITEM_FIELDS) + ">"


def item_struct(text: Column, to_usd: Callable[[Column], Column] | None = None) -> Column:
    """An item's fields from its ~-separated parts. The last part of a code counts, of a number's code the last that is a number.

    Price and quantity are 0 where they are missing; their product is the refund of a refund event, else the revenue, and
    the other is 0. Fields of lists, creatives and promotions fall back to the event's. to_usd turns an amount into dollars.
    """
    return F.get(_items(F.array(F.concat(F.lit("~"), text)), to_usd), F.lit(0))


def _items(wholes: Column, to_usd: Callable[[Column], Column] | None) -> Column:
    """Items of texts that begin with ~. Lambdas don't share subexpressions: amounts that are used often are made in a pass of their own, and
    parts are cut out only where they are."""

    def field(whole: Column, code: str) -> Column:
        last = F.substring_index(F.substring_index(whole, f"~{code}", -1), "~", 1)
        return F.when(F.contains(whole, F.lit(f"~{code}")), F.coalesce(float_or_null(last), numbers(whole, code)) if ITEM_CODES[code] in ITEM_NUMBERS else last)

    def numbers(whole: Column, code: str) -> Column:
        """Looked at only where the last part of the code is no number."""
        parts = F.transform(F.filter(F.split(whole, "~"), lambda p: p.startswith(code)), lambda p: float_or_null(F.substring(p, 3, 1 << 20)))
        return F.try_element_at(F.filter(parts, lambda v: v.isNotNull()), F.lit(-1))

    def counted(whole: Column) -> Column:
        return F.struct(whole.alias("whole"), F.coalesce(field(whole, "pr"), F.lit(0.0)).alias("price"), F.coalesce(field(whole, "qt"), F.lit(0.0)).alias("quantity"))

    def priced(x: Column) -> Column:
        refund, amount = F.coalesce(F.col("name") == "refund", F.lit(False)), x["price"] * x["quantity"]
        return F.struct(*[x[n].alias(n) for n in ("whole", "price", "quantity")], F.when(refund, amount).otherwise(0.0).alias("item_refund"), F.when(refund, 0.0).otherwise(amount).alias("item_revenue"))

    def complete(x: Column) -> Column:
        made = {n: x[n] for n in ("price", "quantity", "item_refund", "item_revenue")}
        made |= {f"{n}_in_usd": F.lit(None).cast("double") if to_usd is None else to_usd(x[n]) for n in ("price", "item_refund", "item_revenue")}
        made |= {n: field(x["whole"], code) for code, n in ITEM_CODES.items() if n not in made}
        made |= {n: F.coalesce(made[n], F.col(f"params_{n}")) for n in ITEM_FALLBACKS}
        return F.struct(*[made[n].alias(n) for n in ITEM_FIELDS])

    return F.transform(F.transform(F.transform(wholes, counted), priced), complete)


def items_array(to_usd: Callable[[Column], Column] | None = None) -> Column:
    """Items of every parameter whose name begins with pr, in the order of the names; kept if they have an id or a name, which is seen before they are parsed."""
    params = F.coalesce("query_params", F.expr("map()"))
    entries = F.sort_array(F.filter(F.map_entries(params), lambda e: e["key"].startswith("pr")))
    wholes = F.transform(F.flatten(entries["value"]), lambda t: F.concat(F.lit("~"), t))
    kept = F.filter(wholes, lambda w: F.contains(w, F.lit("~id")) | F.contains(w, F.lit("~nm")))
    none = F.array().cast(f"array<{ITEM_TYPE}>")
    return F.when(F.exists(F.map_keys(params), lambda k: k.startswith("pr")), _items(kept, to_usd)).otherwise(none)


def items_sum(field: str) -> Column:
    return F.aggregate("ecommerce_items", F.lit(0.0), lambda a, x: a + F.coalesce(x[field], F.lit(0.0)))


def usd_amount(amount: Column) -> Column:
    """Needs _in_usd, and _usd_rate, the rate of the event's currency, which the pipeline joins: as it is in dollars, else rounded half to even,
    null where the currency or its rate is not known."""
    return F.when(F.col("_in_usd"), amount).otherwise(bankers_round(amount * F.col("_usd_rate")))


def columns(protocol: str = "ga4_gtag", domain: str = "ga4", with_rates: bool = False, excluded: tuple[str, ...] = urls.EXCLUDED_PARAMS) -> list[ColumnDef]:
    """with_rates: the hits carry _usd_rate, see usd_amount; else amounts in dollars are null."""
    out = shared("dl", "dt", "dr", protocol, "ul", "sr", excluded)
    out += [
        param("params_ignore_referrer", "ir", "bool"), param("ignore_referrer", "ir", "bool"), param("params_engagement_time_ms", "_et", "int"), param("client_session_id", "sid"),
        param("client_session_number", "sct", "int"), param("_seg", "seg", "int"), page_param("gtm_debug", "gtm_debug"),
        param("params_content_description", "ep.content"),
        computed("page_load_hash", "timestamp", lambda: F.date_trunc("second", F.timestamp_millis(CASTS["int"](value("_p"))))),
        computed("privacy_analytics_storage", "boolean", lambda: gcs_flag(3)), computed("privacy_ads_storage", "boolean", lambda: gcs_flag(2)),
        computed("params", "array<struct<name:string,value_string:string,value_number:double>>", params_array),
    ]
    for (prefix, cast), names in EVENT_PARAMS.items():
        out += [param(f"params_{n}", f"{prefix}.{n}", cast, f"{domain}.protocols/event/params_{n}") for n in names.split()]
    item_deps = tuple(f"params_{n}" for n in ITEM_FALLBACKS)
    items = "ecommerce_items"
    out += [
        computed(items, f"array<{ITEM_TYPE}>", lambda: items_array(usd_amount if with_rates else None), *item_deps, "_in_usd"),
        computed("_in_usd", "boolean", lambda: F.lower(F.trim("params_currency")) == "usd", "params_currency"),  # once an event, not for each amount of an item
        computed("ecommerce_purchase_revenue", "double", lambda: F.when(F.col("name") == "purchase", items_sum("item_revenue")).otherwise(0.0), items),
        computed("ecommerce_refund_value", "double", lambda: F.when(F.col("name") == "refund", items_sum("item_refund")).otherwise(0.0), items),
        computed("ecommerce_unique_items", "bigint", lambda: F.size(F.array_distinct(F.filter(F.transform(items, lambda x: x["item_id"]), lambda v: v.isNotNull()))).cast("bigint"), items),
        computed("ecommerce_items_total_quantity", "bigint", lambda: F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["quantity"].cast("bigint"), F.lit(0))), items),
        computed("ecommerce_shipping_value", "double", lambda: F.col("params_shipping"), "params_shipping"),
        param("ecommerce_tax_value", "epn.tax", "float"),
    ]
    return out


def usd_columns() -> list[ColumnDef]:
    """Amounts in dollars; they need the rates to be joined."""
    pairs = {"ecommerce_purchase_revenue_in_usd": "ecommerce_purchase_revenue", "ecommerce_refund_value_in_usd": "ecommerce_refund_value", "ecommerce_shipping_value_in_usd": "ecommerce_shipping_value", "ecommerce_tax_value_in_usd": "ecommerce_tax_value"}
    return [computed(out, "double", lambda source=source: usd_amount(F.col(source)), source, "_in_usd") for out, source in pairs.items()]


def custom_param(name: str, parameter: str, kind: str = "string") -> ColumnDef:
    """A declared column over the params array (event scope; not boolean)."""
    if kind == "boolean":
        raise ValueError(f"column {name}: parameters of this protocol have no booleans")
    field = "value_string" if kind == "string" else "value_number"
    return ColumnDef(name, kind, lambda: nested_lookup(F.col("params"), "name", parameter, field, kind), f"custom/{name}", depends_on=("params",))
