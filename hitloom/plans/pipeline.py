"""Requests or hits to the wide table: one row for each event, session values repeated."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import addresses, casts, urls
from ..operators import attribution, devices, filters, lookups, page_flow, session_totals, sessionize
from ..sources import ga4, matomo, requests
from .columns import ColumnDef, Registry

GIVEN = ("id", "name", "ts", "property_id", "property_name", "client_id", "user_id", "ip_address", "headers", "query_params")


@dataclass(frozen=True)
class Protocol:
    """What a tracking protocol brings; pass one of your own as Options.protocol."""

    name: str
    explode: Callable[[DataFrame], DataFrame]
    keys: Callable[[DataFrame], DataFrame]
    columns: Callable[[bool, tuple[str, ...]], list[ColumnDef]]  # with rates?, parameters to strip
    property_key: str = "measurement_id"
    required: tuple[str, ...] = ("client_id", "measurement_id", "name")
    page: str = "dl"
    totals: str = "ga4"
    merged: tuple[tuple[str, str, str], ...] = ()  # array, its key, the session's column


def _ga4(tracking: str, domain: str) -> Callable[[bool, tuple[str, ...]], list[ColumnDef]]:
    return lambda rates, excluded: ga4.columns(tracking, domain, rates, excluded) + (ga4.usd_columns() if rates else [])


#: What rows of the native protocol say of it (fixed value).
NATIVE = "d8a"
PROTOCOLS = {
    "ga4": Protocol("ga4", requests.explode_ga4, requests.keys_ga4, _ga4("ga4_gtag", "ga4")),
    "native": Protocol("native", requests.explode_ga4, requests.keys_ga4, _ga4(NATIVE, NATIVE)),
    "matomo": Protocol(
        "matomo", requests.explode_matomo, requests.keys_matomo, lambda _, excluded: matomo.columns(excluded), "site_id", ("client_id", "name"), "url", "matomo",
        (("_session_variables", "name", "session_custom_variables"), ("custom_dimensions", "slot", "session_custom_dimensions")),
    ),
}


def protocol_of(named: str | Protocol) -> Protocol:
    return named if isinstance(named, Protocol) else PROTOCOLS[named]


@dataclass
class Options:
    timeout_s: int = 1800
    protocol: str | Protocol = "ga4"
    split: bool = True
    max_session_s: int = 43_200
    max_session_events: int = 1000
    conditions: list[filters.Condition] = field(default_factory=list)
    filter_fields: list[str] = field(default_factory=lambda: ["ip_address", "name", "page_hostname", "page_path", "utm_campaign", "user_id"])
    custom: list[ColumnDef] = field(default_factory=list)
    join_by_stamp: bool = False
    join_by_user: bool = False
    isolate: bool = False
    excluded_params: tuple[str, ...] = urls.EXCLUDED_PARAMS
    with_device: bool = True
    devices: DataFrame | None = None  # a pattern database (operators.devices)


def registry(options: Options, with_rates: bool = False) -> Registry:
    return Registry(protocol_of(options.protocol).columns(with_rates, options.excluded_params), options.custom, given=GIVEN)


def event_columns(hits: DataFrame, options: Options, rates: DataFrame | None = None, geo: DataFrame | None = None) -> DataFrame:
    """Event-scope columns. Lookups join before the columns that need them."""
    df = hits if "property_name" in hits.columns else hits.withColumn("property_name", F.lit(""))
    if rates is not None and protocol_of(options.protocol).totals == "ga4":
        dollars = rates.where("quote = 'usd'").select(F.col("base").alias("_base"), F.col("rate").alias("_usd_rate"))
        df = df.join(lookups.small(dollars), F.lower(F.trim(casts.str_or_null(requests.value("ep.currency")))) == F.col("_base"), "left").drop("_base")
    df = registry(options, rates is not None).project(df, "event").drop("_usd_rate")
    if geo is not None:
        df = lookups.ip_ranges(df, geo)
    if options.devices is not None:
        return devices.with_device(df, options.devices)
    return lookups.with_device(df) if options.with_device else df


def isolated(hits: DataFrame, stamp_headers: tuple[str, ...] = sessionize.STAMP_HEADERS) -> DataFrame:
    """Client and user ids hashed with their property, so that properties never meet; session_stamp, unless there is one."""
    out = hits.withColumn("auth_client_id", sessionize.isolated_id("property_id", "client_id"))
    out = out.withColumn("user_key", F.when(F.coalesce("user_id", F.lit("")) != "", sessionize.isolated_id("property_id", "user_id")))
    return out if "session_stamp" in hits.columns else out.withColumn("session_stamp", sessionize.request_stamp(stamp_headers))


def build_events(hits: DataFrame, options: Options | None = None, referrers: DataFrame | None = None, rates: DataFrame | None = None, geo: DataFrame | None = None, clients: DataFrame | None = None) -> DataFrame:
    """hits: id, name, ts, property_id, client_id, user_id, ip_address, headers, query_params, with keys extracted.

    An event whose page address can't be parsed is broken.

    Order: identity, sessions, split, event columns, filter, session-scoped columns, session values, attribution. Broken events go
    last, so they count in their session; a session with an event whose page address is broken goes whole.

    Hits that bring proto_seq, split_idx and _split_cause keep them: their sessions were made by a stream.

    clients: see sessionize.sessionize and clients_of; not used where clients are joined or isolated.

    The input is read once: all lookups are broadcast constants or tables, and the windows of a session share one exchange and order.
    """
    o = options or Options()
    p = protocol_of(o.protocol)
    joined = o.join_by_stamp or o.join_by_user
    closed = {"proto_seq", "split_idx", "_split_cause"} <= set(hits.columns)  # a stream has joined clients, made the sessions and cut them
    if closed and joined:
        hits = hits.withColumnsRenamed({"client_id": "stitched_client_id", "own_client_id": "client_id"})
    elif joined or o.isolate:
        hits = isolated(hits)
    else:
        hits = hits.withColumn("auth_client_id", F.col("client_id"))
    key = ["property_id", "client_id"]
    if joined and not closed:
        keyed = hits.withColumnsRenamed({"user_id": "_user_id", "client_id": "_client_id"}).withColumnsRenamed({"user_key": "user_id", "auth_client_id": "client_id"})
        stitched = sessionize.stitch(keyed, o.timeout_s, o.join_by_stamp, o.join_by_user)
        hits = stitched.withColumnsRenamed({"user_id": "user_key", "client_id": "auth_client_id"}).withColumnsRenamed({"_user_id": "user_id", "_client_id": "client_id"})
    elif o.isolate and not closed:
        hits = hits.withColumn("stitched_client_id", F.col("auth_client_id"))
    if joined or (o.isolate and not closed):
        key = ["property_id", "stitched_client_id"]
    session = [*key, *page_flow.SESSION[2:]]
    hits = hits.withColumn("utm_campaign", casts.str_or_null(urls.query_param(requests.value(p.page), "utm_campaign")))
    df = hits if closed else sessionize.sessionize(hits, o.timeout_s, key, clients=clients if key[1] == "client_id" else None)
    df = df if closed else sessionize.split(df, o.max_session_s, o.max_session_events, group=[*key, "proto_seq"]) if o.split else df.withColumn("split_idx", F.lit(0).cast("bigint")).withColumn("_split_cause", F.lit(None).cast("string"))
    df = event_columns(df.drop("utm_campaign"), o, rates, geo)
    df = filters.apply_filters(df, o.conditions, o.filter_fields)
    windows = page_flow.SessionWindows(session)
    df = page_flow.add_page_flow(df, windows)
    if referrers is not None:
        alone = registry(o).project(hits.withColumn("property_name", F.lit("")), "event", only={"page_referrer"})
        df = attribution.attribute(df, referrers, first=F.col("session_hit_number") == 0, referrers=alone)
        df = df.withColumns({c: F.first(c).over(windows.ordered) for c in ("session_source", "session_medium", "session_term")})
    df = session_totals.on_every_event(df, p.totals, session)
    df = session_totals.mode_values_on_every_event(df, keys=session, several=joined)
    for array, name, out in p.merged:
        df = session_totals.merged_on_every_event(df, array, name, "value", out, session)
    df = registry(o, rates is not None).project(df.withColumn("_session", F.lit(True)), "session", over=Window.partitionBy(*session).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # Broken: what a column says that must not be null, and an empty name; an address that can't be read breaks the session.
    must = [F.col(c.name).isNull() for c in registry(o, rates is not None).columns.values() if c.breaks]
    bad_event = reduce(lambda a, b: a | b, must, F.coalesce("name", F.lit("")) == "")
    bad_session = F.bool_or(F.col("page_location").isNull()).over(windows.every)
    wide = df.withColumn("_bad", bad_event | bad_session).where(~F.col("_bad"))
    hidden = [c for c in wide.columns if c.startswith("_")]
    return wide.drop(*hidden, "query_params", "headers", "proto_seq", "split_idx", "auth_client_id", "stitched_client_id", "user_key", "session_stamp", "errors")


def hits_from_requests(raw: DataFrame, protocol: str | Protocol = "ga4", settings: DataFrame | None = None, mask_level: int = 0, trusted_proxy: bool = False, max_bytes: int | None = None) -> DataFrame:
    """Requests to hits with keys, in the order of intake: explode, client address, mask, keys, property, validation.

    id is derived from the request's id and the line. settings: measurement_id (site_id for Matomo), property_id, property_name,
    property_protocol; hits without a known property go to the rejects. max_bytes: judge hits by the validation rules.
    Hits that aren't valid have their errors in the column errors; see rejects().
    """
    p = protocol_of(protocol)
    rows = p.explode(raw)
    rows = rows.withColumn("id", F.sha2(F.concat_ws("|", "request_id", F.coalesce("_line_no", F.lit(0))), 256)).drop("_line_no")
    if trusted_proxy:
        rows = rows.withColumn("ip_address", addresses.real_ip(F.col("headers"), F.col("ip_address"), F.lit(True)))
    if mask_level:
        rows = rows.withColumn("ip_address", addresses.mask_ip(F.col("ip_address"), mask_level))
    rows = p.keys(rows)
    if settings is not None:
        rows = lookups.with_property(rows.drop("property_id"), settings, default=True, key=p.property_key)
    rows = rows.withColumn("ts", F.col("server_received_time"))
    if max_bytes is not None:
        return requests.with_errors(rows, max_bytes, p.name if settings is not None else None)
    return rows.where(requests.has_keys(p.required) & (F.col("property_id").isNotNull() if "property_id" in rows.columns else F.lit(True)))


def clients_of(raw: DataFrame) -> DataFrame:
    """client_id of each hit of GA4 or native requests, of those that will be rejected too, without parsing all parameters: a body line's, else the address's."""
    lines = F.filter(F.split(F.coalesce("body", F.lit("")), "\r?\n"), lambda x: F.trim(x) != "")
    asked = raw.select("query", F.explode_outer(lines).alias("_line"))
    own = urls.param_of_query(F.col("_line"), "cid")
    return asked.select(F.coalesce(F.nullif(own, F.lit("")), urls.param_of_query(F.col("query"), "cid")).alias("client_id"))


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.size("errors") == 0).drop("errors")


def rejects(judged: DataFrame) -> DataFrame:
    """Hits that broke a rule, with all their errors: for a dead-letter sink."""
    return judged.where(F.size("errors") > 0)
