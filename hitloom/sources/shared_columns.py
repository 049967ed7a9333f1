"""Event columns that all protocols share. Parameters of the page address are read from the original address,
before excluded parameters were stripped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.casts import CAST_SQL, CASTS, TYPES
from ..plans.columns import ColumnDef, session_column
from .requests import value

CAMPAIGN_PARAMS = ("utm_campaign", "utm_source", "utm_medium", "utm_content", "utm_term", "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic")
CLICK_PARAMS = ("gclid", "dclid", "gbraid", "srsltid", "wbraid", "fbclid", "msclkid")
NULL_COLUMNS = ("geo_metro", "geo_sub_continent")


def param(name: str, source: str, cast: str = "str", interface: str = "", breaks: bool = False) -> ColumnDef:
    """A request parameter with a cast."""
    sql = CAST_SQL[cast].format(v=urls.first_value_sql("query_params", source))
    return ColumnDef(name, TYPES[cast], lambda: F.expr(sql), interface or name, breaks=breaks, doc=f"request parameter {source}")


def page_param(name: str, source: str) -> ColumnDef:
    """A parameter of the page's original address."""
    sql = CAST_SQL["str"].format(v=urls.first_value_sql("_page_query", source))
    return ColumnDef(name, "string", lambda: F.expr(sql), f"events/{name}", depends_on=("_page_query",), doc=f"page parameter {source}")


def session_param(name: str, source: str, cast: str = "str") -> ColumnDef:
    """A request parameter of the session's last event, null included."""
    sql = CAST_SQL[cast].format(v=urls.first_value_sql("query_params", source))
    return session_column(name, TYPES[cast], lambda: F.last(F.expr(sql)), doc=f"request parameter {source} of the last event")


def computed(name: str, kind: str, build, *deps: str, **more) -> ColumnDef:
    return ColumnDef(name, kind, build, f"events/{name}", depends_on=deps, **more)


def language(source: str) -> ColumnDef:
    return computed("device_language", "string", lambda: F.coalesce(F.nullif(value(source), F.lit("")), F.nullif(F.get(F.try_element_at("headers", F.lit("Accept-Language")), F.lit(0)), F.lit(""))))


def gcs_flag(index: int) -> Column:
    return CASTS["bool"](F.nullif(F.substring(value("gcs"), index + 1, 1), F.lit("")))


def shared(page: str, title: str, referrer: str, protocol: str, lang: str, resolution: str, excluded=urls.EXCLUDED_PARAMS) -> list[ColumnDef]:
    out = [
        computed("original_page_location", "string", lambda: value(page)),
        computed("_page_readable", "boolean", lambda: F.when(urls.readable(F.coalesce("original_page_location", F.lit(""))), True), "original_page_location", breaks=True),
        computed("_page_query", "map<string,array<string>>", lambda: urls.parse_query(urls.query(F.coalesce(F.nullif("original_page_location", F.lit("")), F.col("page_location")))), "original_page_location", "page_location"),
        computed("page_location", "string", lambda: urls.strip_params(F.coalesce(F.col("original_page_location"), F.lit("")), tuple(excluded)), "original_page_location"),
        computed("page_hostname", "string", lambda: urls.host(F.col("page_location")), "page_location"),
        computed("page_path", "string", lambda: urls.path(F.col("page_location")), "page_location"),
        computed("page_title", "string", lambda: value(title)),
        computed("page_referrer", "string", lambda: value(referrer)),
        computed("tracking_protocol", "string", lambda: F.lit(protocol)),
        computed("platform", "string", lambda: F.lit("web")),
        computed("timestamp_utc", "timestamp", lambda: F.date_trunc("second", "ts")),
        computed("date_utc", "date", lambda: F.to_date("ts")),
        language(lang),
        param("device_screen_resolution", resolution),
    ]
    out += [page_param(c, c) for c in CAMPAIGN_PARAMS]
    out += [page_param(f"click_id_{c}", c) for c in CLICK_PARAMS]
    out += [computed(c, "string", lambda: F.lit(None).cast("string")) for c in NULL_COLUMNS]
    return out
