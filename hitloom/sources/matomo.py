"""Matomo columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.urls import EXCLUDED_PARAMS, first_value_sql
from ..operators.lookups import nested_lookup
from ..plans.columns import ColumnDef
from .requests import value
from .shared_columns import computed, param, shared

#: column -> parameter, cast (fixed values)
PARAMS = {
    "params_page_view_id": ("pv_id", "str"), "params_goal_id": ("idgoal", "str"), "params_category": ("e_c", "str"), "params_action": ("e_a", "str"), "params_value": ("e_v", "float"),
    "params_site_id": ("idsite", "str"), "params_link_url": ("link", "str"), "params_download_url": ("download", "str"), "params_search_term": ("search", "str"),
    "params_search_keyword": ("search", "str"), "params_search_category": ("search_cat", "str"), "params_search_count": ("search_count", "int"),
    "params_content_interaction": ("c_i", "str"), "params_content_name": ("c_n", "str"), "params_content_piece": ("c_p", "str"), "params_content_target": ("c_t", "str"),
    "params_media_asset_id": ("ma_id", "str"), "params_media_type": ("ma_mt", "str"), "ecommerce_purchase_revenue": ("revenue", "float"), "ecommerce_shipping_value": ("ec_sh", "float"),
    "ecommerce_subtotal_value": ("ec_st", "float"), "ecommerce_tax_value": ("ec_tx", "float"), "ecommerce_discount_value": ("ec_dt", "float"), "ecommerce_order_id": ("ec_id", "str"),
    "params_product_price": ("_pkp", "float"), "params_product_sku": ("_pks", "str"), "params_product_name": ("_pkn", "str"),
}
PAIRS = "array<struct<name:string,value:string>>"
ITEM = "array<struct<item_id:string,item_name:string,item_category:string,item_category2:string,item_category3:string,item_category4:string,item_category5:string,price:double,quantity:double>>"


def custom_variables(source: str) -> Column:
    """{"slot": [name, value]}: pairs only, by slot as a number, then as text; malformed JSON gives null."""
    entries = F.map_entries(F.from_json(value(source), "map<string,array<string>>"))
    rows = F.transform(F.filter(entries, lambda e: F.size(e["value"]) == 2), lambda e: F.struct(F.coalesce(e["key"].try_cast("int"), F.lit(1 << 30)).alias("n"), e["key"].alias("k"), e["value"].alias("v")))
    return F.nullif(F.transform(F.array_sort(rows), lambda r: F.struct(r["v"][0].alias("name"), r["v"][1].alias("value"))), F.array().cast(PAIRS))


def custom_dimensions() -> Column:
    """dimensionN parameters: last non-empty value of each, by slot."""
    entries = F.map_entries(F.map_filter(F.coalesce("query_params", F.expr("map()")), lambda k, _: k.rlike("^dimension[0-9]+$")))
    rows = F.transform(entries, lambda e: F.struct(F.substring(e["key"], 10, 20).try_cast("bigint").alias("slot"), F.try_element_at(e["value"], F.lit(-1)).alias("value")))
    return F.array_sort(F.filter(rows, lambda r: r["slot"].isNotNull() & (r["value"] != "")))


#: The order's items as SQL text over a JSON text {raw}; what a slot holds counts only if it has the slot's type.
_ITEMS = "try_variant_get(try_parse_json({raw}), '$', 'array<variant>')"
_IS_NUMBER = "schema_of_variant({x}) rlike '^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)'"
_SLOT = "get(s.a, {i})"
_TEXT = "case when schema_of_variant({x}) = 'STRING' then try_variant_get({x}, '$', 'string') end"


def _categories_sql() -> str:
    slot, text = "get(a, 2)", lambda x: _TEXT.format(x=x)
    several = f"transform(try_variant_get({slot}, '$', 'array<variant>'), v -> {text('v')})"
    return f"case when schema_of_variant({slot}) = 'STRING' then array({text(slot)}) when schema_of_variant({slot}) like 'ARRAY%' then {several} end"


def _item_sql() -> str:
    """Of s, an item's slots (a) and categories (c), which are made once: what a lambda repeats is evaluated again."""
    slot = [_SLOT.format(i=i) for i in range(5)]
    text = lambda x: _TEXT.format(x=x)
    number = lambda x, default: f"case when {_IS_NUMBER.format(x=x)} then coalesce(try_variant_get({x}, '$', 'double'), {default}D) else {default}D end"
    sku = f"case when schema_of_variant({slot[0]}) = 'STRING' or schema_of_variant({slot[0]}) = 'BOOLEAN' or {_IS_NUMBER.format(x=slot[0])} then try_variant_get({slot[0]}, '$', 'string') end"
    category = [f"nullif(get(s.c, {i}), '')" for i in range(5)]
    fields = [f"{sku} as item_id", f"coalesce({text(slot[1])}, '') as item_name", f"coalesce({category[0]}, '') as item_category"]
    fields += [f"{c} as item_category{i}" for i, c in enumerate(category[1:], 2)]
    return "struct(" + ", ".join([*fields, f"{number(slot[3], 0.0)} as price", f"{number(slot[4], 1.0)} as quantity"]) + ")"


def order_items() -> Column:
    """[[sku, name, category or up to five categories, price, quantity], ...] with mixed types. A sku may be a text, number or boolean, items
    without one go; a slot of another type counts as missing: name and first category are "", price 0, quantity 1."""
    arrays = f"transform({_ITEMS.format(raw=first_value_sql('query_params', 'ec_items'))}, x -> try_variant_get(x, '$', 'array<variant>'))"
    return F.expr(f"filter(transform(transform(filter({arrays}, a -> size(a) > 0), a -> struct(a as a, {_categories_sql()} as c)), s -> {_item_sql()}), r -> coalesce(r.item_id, '') <> '')")


def items_readable() -> Column:
    """True, or null for an event whose items are no JSON array: such an event is broken."""
    raw = first_value_sql("query_params", "ec_items")
    return F.expr(f"case when coalesce({raw}, '') = '' or {_ITEMS.format(raw=raw)} is not null then true end")


def category(i: int) -> Column:
    raw = F.nullif(value("_pkc"), F.lit(""))
    return F.nullif(F.get(F.coalesce(F.from_json(raw, "array<string>"), F.array(raw)), F.lit(i)), F.lit(""))


def columns(excluded: tuple[str, ...] = EXCLUDED_PARAMS) -> list[ColumnDef]:
    out = shared("url", "action_name", "urlref", "matomo", "lang", "res", excluded)
    out += [param(name, source, cast) for name, (source, cast) in PARAMS.items()]
    out += [
        computed("ignore_referrer", "boolean", lambda: F.coalesce(F.lower(value("ignore_referrer")).isin("1", "true"), F.lit(False))),
        computed("custom_variables", PAIRS, lambda: custom_variables("cvar")),
        computed("_session_variables", PAIRS, lambda: custom_variables("_cvar")),
        computed("custom_dimensions", "array<struct<slot:bigint,value:string>>", custom_dimensions),
        computed("ecommerce_items", ITEM, order_items), computed("_items_readable", "boolean", items_readable, breaks=True),
        computed("ecommerce_items_total_quantity", "bigint", lambda: F.aggregate("ecommerce_items", F.lit(0).cast("bigint"), lambda a, x: a + x["quantity"].cast("bigint")), "ecommerce_items"),
        computed("_idn", "string", lambda: value("_idn")),
    ]
    out += [computed(f"params_product_category_{i + 1}", "string", lambda i=i: category(i)) for i in range(5)]
    return out


def custom_dimension(name: str, slot: int) -> ColumnDef:
    return ColumnDef(name, "string", lambda: nested_lookup(F.col("custom_dimensions"), "slot", str(slot), "value"), f"custom/{name}", depends_on=("custom_dimensions",))


def custom_variable(name: str, variable: str) -> ColumnDef:
    return ColumnDef(name, "string", lambda: nested_lookup(F.col("custom_variables"), "name", variable, "value"), f"custom/{name}", depends_on=("custom_variables",))
