"""Raw requests to hits: explode, key extraction, validation. A request row has ip_address, host, server_received_time, path,
method, query (raw query string), headers (map of arrays), body (string)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

MAX_BYTES = 128 * 1024


def value(name: str) -> Column:
    return F.expr(urls.first_value_sql("query_params", name))


def _merged(base: Column, over: Column) -> Column:
    """Keys of `over` replace those of `base`."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def explode_ga4(requests: DataFrame) -> DataFrame:
    """One hit for each non-blank body line, whose parameters replace the address's; an empty body gives one hit.

    Parameters are parsed inside the explode, so that they are parsed once, whatever filters follow."""
    lines = F.filter(F.split(F.coalesce("body", F.lit("")), "\r?\n"), lambda x: F.trim(x) != "")
    address = urls.parse_query(F.col("query"))
    hits = lambda a: F.when(F.size(lines) > 0, F.transform(lines, lambda x: _merged(a, urls.parse_query(x)))).otherwise(F.array(a))
    # The outer kind: for the inner one Spark would parse everything once more, to filter by size.
    return requests.select("*", F.posexplode_outer(urls.let(address, hits)).alias("_line_no", "query_params"))


def explode_matomo(requests: DataFrame) -> DataFrame:
    """A body that is a JSON object holds bulk requests as query strings; else the address is the one hit."""
    bulk = F.from_json("body", "requests array<string>")["requests"]
    is_bulk = F.coalesce(F.ltrim("body").startswith("{"), F.lit(False))
    texts = F.when(is_bulk, F.transform(F.coalesce(bulk, F.array().cast("array<string>")), lambda r: F.regexp_replace(r, r"^\?", ""))).otherwise(F.array("query"))
    return requests.select("*", F.posexplode_outer(F.transform(texts, urls.parse_query)).alias("_line_no", "query_params")).where("_line_no is not null")


def keys_ga4(hits: DataFrame) -> DataFrame:
    """client_id, measurement_id, user_id and name."""
    return hits.withColumns({"client_id": value("cid"), "measurement_id": value("tid"), "user_id": F.nullif(value("uid"), F.lit("")), "name": value("en")})


def has_keys(names: tuple[str, ...]) -> Column:
    """Does the hit have the keys that its protocol asks for?"""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(n), F.lit("")) != "" for n in names])


def matomo_event_name() -> Column:
    has = lambda n: F.coalesce(value(n), F.lit("")) != ""
    rules = [
        ((value("idgoal") == "0") & has("ec_id"), "ecommerce_order"),
        (has("idgoal"), "goal_conversion"),
        (has("ma_id") & (value("ma_mt") == "video"), "video_play"),
        (has("download"), "download"),
        (has("link"), "outlink"),
        (F.map_contains_key("query_params", "search"), "site_search"),
        (has("c_i"), "content_interaction"),
        (has("c_n"), "content_impression"),
        (has("e_c") & has("e_a"), "custom_event"),
    ]
    chain = F
    for condition, name in rules:
        chain = chain.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    return chain.otherwise(F.lit("page_view"))


def keys_matomo(hits: DataFrame) -> DataFrame:
    """client_id from _id, cid, else derived from the hit's id; site id, user and event name."""
    pick = lambda n: F.nullif(value(n), F.lit(""))
    return hits.withColumns({"client_id": F.coalesce(pick("_id"), pick("cid"), F.sha2(F.concat_ws("|", F.lit("client"), "id"), 256)), "site_id": value("idsite"), "user_id": pick("uid"), "name": matomo_event_name()})


#: Rule name -> what a valid hit satisfies.
def validation_rules(max_bytes: int = MAX_BYTES, protocol: str | None = None) -> dict[str, Column]:
    """protocol: that of the endpoint; the hits must carry property_protocol, that of their property's settings."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    rules = {
        "client_id": filled("client_id"), "property_id": filled("property_id"), "name": filled("name"), "host": filled("host"), "path": filled("path"), "method": filled("method"),
        "headers": F.col("headers").isNotNull() & (F.size("headers") > 0), "query_params": F.col("query_params").isNotNull(), "body": F.col("body").isNotNull(),
        "size": reduce(lambda a, b: a + b, [F.octet_length(F.coalesce(x, F.lit(""))) for x in (F.col("body"), F.to_json("query_params"), F.to_json("headers"))]) <= max_bytes,
    }
    return rules | ({"protocol": F.col("property_protocol") == protocol} if protocol else {})


def with_errors(hits: DataFrame, max_bytes: int = MAX_BYTES, protocol: str | None = None) -> DataFrame:
    """Append errors, the names of all rules that the hit breaks; valid hits have none."""
    rules = validation_rules(max_bytes, protocol)
    return hits.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def validate(hits: DataFrame, max_bytes: int = MAX_BYTES, protocol: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid hits, and rejected ones with all their errors (for a dead-letter sink)."""
    judged = with_errors(hits, max_bytes, protocol)
    return judged.where(F.size("errors") == 0).drop("errors"), judged.where(F.size("errors") > 0)
