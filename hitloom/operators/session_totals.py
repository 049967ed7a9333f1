"""Values of a session, repeated on each of its events by windows (embedded layout) or as one row by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .page_flow import SESSION, SessionWindows


def on(agg: Column, w: WindowSpec | None) -> Column:
    """An aggregate as it is, or over a window."""
    return agg if w is None else agg.over(w)


def total_of(names: tuple[str, ...], w: WindowSpec | None = None) -> Column:
    """Events with one of the names."""
    return on(F.count_if(F.col("name").isin(*names)), w)


def unique_of(names: tuple[str, ...], value: str, w: WindowSpec | None = None) -> Column:
    """Distinct (name, value) of those events; a null value counts as one value."""
    pair = F.concat_ws("||", F.col("name"), F.coalesce(F.col(value).cast("string"), F.lit("<nil>")))
    return F.size(on(F.collect_set(F.when(F.col("name").isin(*names), pair)), w)).cast("bigint")


def first_match(match: Column, value: str, w: WindowSpec | None = None) -> Column:
    """Value (null included) of the matching event that comes first. The place travels with it, so order doesn't depend on a shuffle."""
    return on(F.min(F.when(match, F.struct("ts", "id", F.struct(F.col(value).alias("v")).alias("s")))), w)["s"]["v"]


def last_match(match: Column, value: str, w: WindowSpec | None = None) -> Column:
    return on(F.max(F.when(match, F.struct("ts", "id", F.struct(F.col(value).alias("v")).alias("s")))), w)["s"]["v"]


def nth_value(match: Column, value: str, n: int, nth: str = "_nth") -> Column:
    """Value of the n-th matching event (from 0). Needs its running number in the column nth, see add_numbers."""
    return first_match(match & (F.col(nth) == n + 1), value)


def add_numbers(df: DataFrame, keys: list[str], page: str = "page_view") -> DataFrame:
    """_nth: the running number of page views in a session."""
    w = Window.partitionBy(*keys).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_nth", F.count_if(F.col("name") == page).over(w))


def engaged(w: WindowSpec | None = None, flag: Column | None = None) -> Column:
    total = lambda n: on(F.count_if(F.col("name") == n), w)
    rule = (total("page_view") >= 2) | (total("screen_view") >= 2) | (total("purchase") >= 1)
    return rule if flag is None else rule | F.coalesce(on(F.bool_or(flag != 0), w), F.lit(False))


def abandoned_cart(w: WindowSpec | None = None, cart: str = "add_to_cart", purchase: str = "purchase") -> Column:
    """Is the last cart event after the last purchase (or is there none)?"""
    at = lambda n: on(F.max(F.when(F.col("name") == n, F.struct("ts", "id"))), w)
    return F.coalesce(at(cart).isNotNull() & (at(purchase).isNull() | (at(cart) > at(purchase))), F.lit(False))


#: Session totals: output -> event names (fixed values). ga4 covers the native protocol too.
TOTALS = {
    "ga4": {
        "session_total_page_views": ("page_view",),
        "session_total_purchases": ("purchase",),
        "session_total_scrolls": ("scroll",),
        "session_total_outbound_clicks": ("click",),
        "session_total_site_searches": ("view_search_results", "search"),
        "session_total_form_interactions": ("form_submit", "form_start"),
        "session_total_video_engagements": ("video_start", "video_complete", "video_progress"),
        "session_total_file_downloads": ("file_download",),
    },
    "matomo": {
        "session_total_page_views": ("page_view",),
        "session_total_purchases": ("ecommerce_order",),
        "session_total_goal_conversions": ("goal_conversion",),
        "session_total_outbound_clicks": ("outlink",),
        "session_total_site_searches": ("site_search",),
        "session_total_video_engagements": ("video_play",),
        "session_total_file_downloads": ("download",),
        "session_total_content_impressions": ("content_impression",),
        "session_total_content_interactions": ("content_interaction",),
    },
}
UNIQUES = {
    "ga4": {
        "session_unique_page_views": (("page_view",), "page_location"),
        "session_unique_outbound_clicks": (("click",), "params_link_url"),
        "session_unique_site_searches": (("view_search_results", "search"), "params_search_term"),
        "session_unique_form_interactions": (("form_submit", "form_start"), "params_form_id"),
        "session_unique_file_downloads": (("file_download",), "params_link_url"),
    },
    "matomo": {
        "session_unique_page_views": (("page_view",), "page_location"),
        "session_unique_outbound_clicks": (("outlink",), "params_link_url"),
        "session_unique_site_searches": (("site_search",), "params_search_term"),
        "session_unique_file_downloads": (("download",), "params_download_url"),
    },
}
CAMPAIGN = ("utm_campaign", "utm_source", "utm_medium", "utm_content", "utm_term", "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic", "click_id_gclid", "click_id_dclid", "click_id_gbraid", "click_id_srsltid", "click_id_wbraid", "click_id_fbclid", "click_id_msclkid")
OF_MODE_CLIENT = ("geo_city", "geo_region", "geo_metro", "geo_country", "geo_continent", "geo_sub_continent", "device_category", "device_language", "device_mobile_brand_name", "device_mobile_model_name", "device_operating_system", "device_operating_system_version", "device_web_browser", "device_web_browser_version", "device_screen_resolution")


def session_values(have: set[str], protocol: str = "ga4", w: WindowSpec | None = None) -> dict[str, Column]:
    """The session columns that these event columns allow, as aggregates or over a window; _nth must be there."""
    page = F.col("name") == "page_view"
    start, end = on(F.min("ts"), w), on(F.max("ts"), w)
    out = {
        "session_id": first_match(F.lit(True), "id", w),
        "session_total_events": on(F.count("*"), w),
        "session_first_event_time": F.date_trunc("second", start),
        "session_last_event_time": F.date_trunc("second", end),
        "session_duration": F.unix_seconds(end) - F.unix_seconds(start),
        "session_is_bounced": on(F.count_if(page), w) == 1,
    }
    for name, source in (("session_client_id", "client_id"), ("session_referrer", "page_referrer"), ("session_split_cause", "_split_cause")):
        if source in have:
            out[name] = first_match(F.lit(True), source, w)
    for part in ("location", "title"):
        if f"page_{part}" in have:
            out[f"session_entry_page_{part}"] = first_match(page, f"page_{part}", w)
            out[f"session_second_page_{part}"] = first_match(page & (F.col("_nth") == 2), f"page_{part}", w)
            out[f"session_exit_page_{part}"] = last_match(page, f"page_{part}", w)
    out |= {f"session_{c}": first_match(page, c, w) for c in CAMPAIGN if c in have}
    out |= {name: total_of(names, w) for name, names in TOTALS[protocol].items()}
    out |= {name: unique_of(names, value, w) for name, (names, value) in UNIQUES[protocol].items() if value in have}
    if protocol == "ga4":
        out["session_is_engaged"] = engaged(w, F.col("_seg") if "_seg" in have else None)
        out["session_abandoned_cart"] = abandoned_cart(w)
        if "client_session_number" in have:
            out["session_returning_user"] = F.coalesce(on(F.bool_or(F.col("client_session_number") >= 2), w), F.lit(False))
    else:
        for c in ("session_total_scrolls", "session_total_form_interactions", "session_unique_form_interactions"):
            out[c] = on(F.max(F.lit(None).cast("bigint")), w)
        if "_idn" in have:
            out["session_returning_user"] = first_match(F.lit(True), "_idn", w) == "0"
    return out


def session_rows(df: DataFrame, protocol: str = "ga4", keys: list[str] = SESSION) -> DataFrame:
    """One row a session, by aggregation."""
    values = session_values(set(df.columns), protocol)
    return add_numbers(df, keys).groupBy(*keys).agg(*[c.alias(k) for k, c in values.items()])


def on_every_event(df: DataFrame, protocol: str = "ga4", keys: list[str] = SESSION) -> DataFrame:
    """The same values on each event row, by windows: no join, and the exchange of the other session windows serves."""
    every = Window.partitionBy(*keys)
    return add_numbers(df, keys).withColumns(session_values(set(df.columns), protocol, every)).drop("_nth")


def mode_values_on_every_event(df: DataFrame, columns: tuple[str, ...] = OF_MODE_CLIENT, client: str = "auth_client_id", keys: list[str] = SESSION, several: bool = True) -> DataFrame:
    """session_<column> by windows: the first event's value of the most frequent client (ties: the one that came first).

    several: can a session have several clients? If not, the session's first event has the values."""
    columns = tuple(c for c in columns if c in df.columns)
    if not several:
        ordered = Window.partitionBy(*keys).orderBy("ts", "id")
        return df.withColumns({f"session_{c}": F.first(c).over(ordered) for c in columns})
    own = Window.partitionBy(*keys, client)
    df = df.withColumns({"_n": F.count("*").over(own), "_at": F.min(F.struct("ts", "id", F.struct(*columns).alias("v"))).over(own)})
    best = F.min(F.struct((-F.col("_n")).alias("n"), "_at")).over(Window.partitionBy(*keys))
    df = df.withColumn("_mode", best)
    return df.withColumns({f"session_{c}": F.col("_mode._at.v")[c] for c in columns}).drop("_n", "_at", "_mode")


def mode_client_values(df: DataFrame, columns: tuple[str, ...] = OF_MODE_CLIENT, client: str = "auth_client_id", keys: list[str] = SESSION) -> DataFrame:
    """session_<column>: the first event's value of the session's most frequent client (ties: the one that came first)."""
    columns = tuple(c for c in columns if c in df.columns)
    first = F.min(F.struct("ts", "id", F.struct(*columns).alias("v"))).alias("first")
    by_client = df.groupBy(*keys, client).agg(F.count("*").alias("n"), first)
    best = by_client.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("first.ts").alias("ts"), F.col("first.id").alias("id"), F.col("first.v").alias("v")))["v"].alias("v"))
    return best.select(*keys, *[F.col(f"v.{c}").alias(f"session_{c}") for c in columns])


def merged_by_key(df: DataFrame, array: str, key: str, value: str, out: str, keys: list[str] = SESSION) -> DataFrame:
    """Array of (key, value) structs merged over a session: the last value of each key, sorted by key; null when empty."""
    rows = df.select(*keys, "ts", "id", F.posexplode(array).alias("_i", "_x"))
    last = rows.groupBy(*keys, F.col(f"_x.{key}").alias(key)).agg(F.max(F.struct("ts", "id", "_i", F.col(f"_x.{value}").alias("v")))["v"].alias(value))
    return last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(key, value))).alias(out))


def merged_on_every_event(df: DataFrame, array: str, key: str, value: str, out: str, keys: list[str] = SESSION) -> DataFrame:
    """The same on each event row by a window: the arrays of a session in order, then the last value of each key."""
    ordered = Window.partitionBy(*keys).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    every = F.flatten(F.collect_list(array).over(ordered))  # a split session is bounded
    last = lambda k, all_: F.try_element_at(F.filter(all_, lambda x: x[key] == k), F.lit(-1))[value]
    merged = F.transform(F.array_sort(F.array_distinct(F.transform(F.col("_all"), lambda x: x[key]))), lambda k: F.struct(k.alias(key), last(k, F.col("_all")).alias(value)))
    return df.withColumn("_all", every).withColumn(out, F.when(F.size("_all") > 0, merged)).drop("_all")


def embed(df: DataFrame, sessions: DataFrame, prefix: str = "", keys: list[str] = SESSION, how: str = "inner") -> DataFrame:
    """Session values on every event row. Both sides hash on the same keys, so the events' exchange is reused."""
    right = sessions.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"{prefix}{c}") for c in sessions.columns if c not in keys])
    on = [df[k].eqNullSafe(right[f"_k_{k}"]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    return df.join(right, cond, how).drop(*[f"_k_{k}" for k in keys])


def windowed_totals(df: DataFrame, w: SessionWindows | None = None) -> DataFrame:
    """The plain totals on every event by windows alone: no join, no second exchange."""
    w = w or SessionWindows()
    every = Window.partitionBy(*w.keys)
    return df.withColumns({
        "session_id": F.first("id").over(w.ordered),
        "session_total_events": F.count("*").over(every),
        "session_duration": F.unix_seconds(F.max("ts").over(every)) - F.unix_seconds(F.min("ts").over(every)),
        "session_is_bounced": F.count_if(w.is_page).over(every) == 1,
    })
