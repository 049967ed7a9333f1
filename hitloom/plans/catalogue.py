"""Queries over the driver's tables, each with its SQL.

The table events becomes hits: event_id -> id, user_id -> client_id, view -> page_view, props.k -> page_location.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addresses, casts, urls
from ..operators import attribution, devices, filters, lookups, page_flow, session_totals, sessionize
from ..operators.components import scratch_folder
from ..sources import ga4, matomo, requests, shared_columns
from ..streaming import sessions as streaming
from . import columns, pipeline
from .columns import ColumnDef, Registry, in_one_layout

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["property_id", "client_id", "proto_seq", "split_idx"]
#: The session key of the oracles.
SESSIONS = """
with hits as (
  select cast(event_id as varchar) as id, 'p' || (user_id % 3) as property_id, cast(user_id as varchar) as client_id,
    case event_type when 'view' then 'page_view' else event_type end as name, value, user_id,
    '/p/' || cast(json_extract_string(props, '$.k') as varchar) as page_location,
    case when cast(json_extract_string(props, '$.k') as int) % 5 = 0 then null else 't' || cast(cast(json_extract_string(props, '$.k') as int) % 7 as varchar) end as page_title,
    epoch_us(ts) as us from events),
marked as (select *, case when us - lag(us) over c > 1800000000 then 1 else 0 end as new from hits window c as (partition by property_id, client_id order by us, id)),
s as (select *, cast(sum(new) over (partition by property_id, client_id order by us, id rows unbounded preceding) as bigint) as proto_seq from marked),
n as (select *, row_number() over w - 1 as rn, lag(page_location) over w as prev_loc, name = 'page_view' as pv from s window w as (partition by property_id, client_id, proto_seq order by us, id))
"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.concat(F.lit("p"), F.pmod("user_id", F.lit(3)).cast("string")).alias("property_id"), F.col("user_id").cast("string").alias("client_id"),
        F.when(F.col("event_type") == "view", "page_view").otherwise(F.col("event_type")).alias("name"), "value", F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("/p/"), k).alias("page_location"), F.when(k.cast("int") % 5 == 0, None).otherwise(F.concat(F.lit("t"), (k.cast("int") % 7).cast("string"))).alias("page_title"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize.sessionize(hits(spark, sf_dir)).withColumn("split_idx", F.lit(0).cast("bigint"))


QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(SESSIONS + "select id, client_id, proto_seq from s")
def sessionize_gap(spark, sf_dir):
    return sessions(spark, sf_dir).select("id", "client_id", "proto_seq")


@query(SESSIONS + """select property_id, client_id, proto_seq, count(*) as session_total_events, cast(floor(max(us) / 1000000) - floor(min(us) / 1000000) as bigint) as session_duration,
  arg_min(id, (us, id)) as session_id, count(*) filter (where pv) = 1 as session_is_bounced, cast(floor(min(us) / 1000000) as bigint) as first_s from n group by all""")  # fmt: skip
def session_rows(spark, sf_dir):
    rows = session_totals.session_rows(sessions(spark, sf_dir))
    return rows.select(*KEYS[:3], "session_total_events", "session_duration", "session_id", "session_is_bounced", F.unix_seconds("session_first_event_time").alias("first_s"))


@query(SESSIONS + """select id, cast(rn as bigint) as session_hit_number,
  cast(sum(case when page_location <> prev_loc then 1 else 0 end) over (partition by property_id, client_id, proto_seq order by us, id rows unbounded preceding) as bigint) as session_page_number from n""")  # fmt: skip
def session_hit_and_page_number(spark, sf_dir):
    return page_flow.add_page_flow(sessions(spark, sf_dir)).select("id", "session_hit_number", "session_page_number")


@query(SESSIONS + """, pages as (select *, row_number() over (partition by property_id, client_id, proto_seq order by us, id) as p from n where pv),
run0 as (select *, case when p = 1 or page_location is distinct from lag(page_location) over (partition by property_id, client_id, proto_seq order by p) then 1 else 0 end as st from pages),
runs as (select *, sum(st) over (partition by property_id, client_id, proto_seq order by p rows unbounded preceding) as run from run0),
heads as (select property_id, client_id, proto_seq, run, any_value(page_location) as loc from runs group by all)
, pos as (select n.id, n.property_id, n.client_id, n.proto_seq, coalesce((select max(r.run) from runs r where r.property_id = n.property_id and r.client_id = n.client_id and r.proto_seq = n.proto_seq and r.rn <= n.rn), 0) as run, n.rn from n)
select pos.id, a.loc as previous_page_location, b.loc as next_page_location from pos
left join heads a on a.property_id = pos.property_id and a.client_id = pos.client_id and a.proto_seq = pos.proto_seq and a.run = pos.run - 1
left join heads b on b.property_id = pos.property_id and b.client_id = pos.client_id and b.proto_seq = pos.proto_seq and b.run = pos.run + 1""")  # fmt: skip
def previous_next_page(spark, sf_dir):
    return page_flow.add_page_flow(sessions(spark, sf_dir)).select("id", "previous_page_location", "next_page_location")


@query(SESSIONS + """select id, coalesce(rn = min(case when pv then rn end) over z, false) as session_is_entry_page, coalesce(rn = max(case when pv then rn end) over z, false) as session_is_exit_page,
  pv and count(*) filter (where pv) over z = 1 as page_is_bounce from n window z as (partition by property_id, client_id, proto_seq)""")  # fmt: skip
def entry_exit_bounce(spark, sf_dir):
    return page_flow.add_page_flow(sessions(spark, sf_dir)).select("id", "session_is_entry_page", "session_is_exit_page", "page_is_bounce")


@query(SESSIONS + """, seg as (select *, sum(case when rn = 0 or pv then 1 else 0 end) over (partition by property_id, client_id, proto_seq order by us, id rows unbounded preceding) as seg from n),
b as (select property_id, client_id, proto_seq, seg, min(us) as st from seg group by all),
e as (select *, lead(st) over (partition by property_id, client_id, proto_seq order by seg) as nx from b),
z as (select property_id, client_id, proto_seq, max(us) as last from n group by all)
select seg.id, cast(floor((coalesce(e.nx, z.last) - e.st) / 1000000) as bigint) as time_on_page from seg join e using (property_id, client_id, proto_seq, seg) join z using (property_id, client_id, proto_seq)""")  # fmt: skip
def time_on_page(spark, sf_dir):
    return page_flow.add_page_flow(sessions(spark, sf_dir)).select("id", "time_on_page")


@query(SESSIONS + """select property_id, client_id, proto_seq, count(*) filter (where name = 'page_view') as session_total_page_views, count(*) filter (where name = 'purchase') as session_total_purchases,
  count(*) filter (where name = 'click') as session_total_outbound_clicks,
  cast(count(distinct page_location) filter (where pv) + coalesce(max(case when pv and page_location is null then 1 end), 0) as bigint) as session_unique_page_views,
  cast(count(distinct page_title) filter (where name = 'click') + coalesce(max(case when name = 'click' and page_title is null then 1 end), 0) as bigint) as session_unique_outbound_clicks from n group by all""")  # fmt: skip
def session_totals_and_uniques(spark, sf_dir):
    rows = session_totals.session_rows(sessions(spark, sf_dir).withColumn("params_link_url", F.col("page_title")))
    return rows.select(*KEYS[:3], "session_total_page_views", "session_total_purchases", "session_total_outbound_clicks", "session_unique_page_views", "session_unique_outbound_clicks")


@query(SESSIONS + """, p as (select *, row_number() over (partition by property_id, client_id, proto_seq order by us, id) as i, row_number() over (partition by property_id, client_id, proto_seq order by us desc, id desc) as j from n where pv),
k as (select distinct property_id, client_id, proto_seq from n)
select k.*, a.page_title as session_entry_page_title, b.page_location as session_second_page_location, c.page_title as session_exit_page_title from k
left join p a on a.property_id = k.property_id and a.client_id = k.client_id and a.proto_seq = k.proto_seq and a.i = 1
left join p b on b.property_id = k.property_id and b.client_id = k.client_id and b.proto_seq = k.proto_seq and b.i = 2
left join p c on c.property_id = k.property_id and c.client_id = k.client_id and c.proto_seq = k.proto_seq and c.j = 1""")  # fmt: skip
def session_nth_page(spark, sf_dir):
    return session_totals.session_rows(sessions(spark, sf_dir)).select(*KEYS[:3], "session_entry_page_title", "session_second_page_location", "session_exit_page_title")


@query(SESSIONS + """, m as (select property_id, client_id, proto_seq, name as c, count(*) as k, min(rn) as f, arg_min(page_location, rn) as v from n group by all)
select property_id, client_id, proto_seq, v as session_geo_city from (select *, row_number() over (partition by property_id, client_id, proto_seq order by k desc, f) as r from m) where r = 1""")  # fmt: skip
def session_mode_client(spark, sf_dir):
    rows = sessions(spark, sf_dir).withColumn("geo_city", F.col("page_location"))
    return session_totals.mode_client_values(rows, client="name").select(*KEYS[:3], "session_geo_city")


@query(SESSIONS + """select property_id, client_id, proto_seq, count(*) filter (where name = 'page_view') >= 2 or count(*) filter (where name = 'purchase') >= 1 as session_is_engaged,
  coalesce(max(case when name = 'click' then rn end) > coalesce(max(case when name = 'purchase' then rn end), -1), false) as session_abandoned_cart from n group by all""")  # fmt: skip
def session_engaged_and_cart(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    return rows.groupBy(*KEYS).agg(session_totals.engaged().alias("session_is_engaged"), session_totals.abandoned_cart(cart="click").alias("session_abandoned_cart")).drop("split_idx")


@query("""with recursive hits as (select cast(event_id as varchar) as id, user_id % 20 as g, user_id, epoch_us(ts) as us, row_number() over (partition by user_id % 20 order by ts, cast(event_id as varchar)) as i from events),
r as (select id, g, i, us as first, 1 as n, 0 as split_idx, cast(null as varchar) as cause from hits where i = 1
union all select h.id, h.g, h.i,
  case when h.us - r.first >= 86400000000 or r.n >= 7 then h.us else r.first end,
  case when h.us - r.first >= 86400000000 or r.n >= 7 then 1 else r.n + 1 end,
  case when h.us - r.first >= 86400000000 or r.n >= 7 then r.split_idx + 1 else r.split_idx end,
  case when h.us - r.first >= 86400000000 then 'max_time_since_first_event_reached' when r.n >= 7 then 'max_events_reached' end
from r join hits h on h.g = r.g and h.i = r.i + 1)
select id, cast(split_idx as bigint) as split_idx, cause as session_split_cause from r""")  # fmt: skip
def split_sessions(spark, sf_dir):
    rows = hits(spark, sf_dir).withColumn("g", F.pmod(F.col("user_id").cast("bigint"), F.lit(20))).withColumn("utm_campaign", F.lit(None).cast("string"))
    cut = sessionize.split(rows, max_s=86_400, max_events=7, by_user=False, by_campaign=False, group=["g"])
    return cut.select("id", "split_idx", F.col("_split_cause").alias("session_split_cause"))


@query(SESSIONS + """, c as (select *, case when page_title <> last_value(page_title ignore nulls) over (partition by property_id, client_id, proto_seq order by us, id rows between unbounded preceding and 1 preceding) then 1 else 0 end as ch from n)
select id, cast(sum(ch) over (partition by property_id, client_id, proto_seq order by us, id rows unbounded preceding) as bigint) as split_idx from c""")  # fmt: skip
def split_on_change(spark, sf_dir):
    rows = sessionize.sessionize(hits(spark, sf_dir))
    return sessionize.split_on_change(rows, "page_title").select("id", "split_idx")


CONDITIONS = [
    filters.Condition("no errors", "exclude", "name = 'error' and startswith(page_location, '/p/1')"),
    filters.Condition("some clients", "allow", "client_id rlike '^[0-9]*[02468]$' or name = 'signup'"),
    filters.Condition("watch", "exclude", "endswith(page_location, '7') or not contains(name, 'i')", test_mode=True),
]


@query(SESSIONS + """select id, case when page_location like '%7' or not (name like '%i%') then 'watch' end as traffic_filter_name from n
where not (name = 'error' and page_location like '/p/1%') and (regexp_matches(client_id, '^[0-9]*[02468]$') or name = 'signup')""")  # fmt: skip
def traffic_filter(spark, sf_dir):
    kept = filters.apply_filters(hits(spark, sf_dir), CONDITIONS, ["name", "page_location", "client_id"])
    return kept.select("id", "traffic_filter_name")


@query("""select event_id, '10.' || (event_id % 5) || '.0.' || (user_id % 256) as ip, event_id % 5 = 1 as internal from events""")
def cidr_filter(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ip = F.concat(F.lit("10."), F.pmod("event_id", F.lit(5)), F.lit(".0."), F.pmod("user_id", F.lit(256)))
    rows = e.select("event_id", ip.alias("ip"))
    return filters.apply_filters(rows, [filters.Condition("in", "exclude", "in_cidr(ip, '10.1.0.0/16')", test_mode=True)], ["ip"]).select("event_id", "ip", F.col("traffic_filter_name").isNotNull().alias("internal"))


@query("""with t as (select event_id, case event_id % 6 when 0 then cast(event_id as varchar) when 1 then ' 5' when 2 then '-7' when 3 then '1.5e2' when 4 then 'yes' else '' end as v from events)
select event_id, case when regexp_full_match(v, '[+-]?[0-9]+') then cast(v as bigint) end as i, case when regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then cast(v as double) end as f,
case when lower(trim(v)) in ('true','yes','y','on','1','t') then true when lower(trim(v)) in ('false','no','n','off','0','f') then false end as b, nullif(v, '') as s from t""")  # fmt: skip
def scalar_casts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = F.pmod("event_id", F.lit(6))
    v = F.when(m == 0, F.col("event_id").cast("string")).when(m == 1, " 5").when(m == 2, "-7").when(m == 3, "1.5e2").when(m == 4, "yes").otherwise("")
    t = e.select("event_id", v.alias("v"))
    return t.select("event_id", casts.int_or_null(F.col("v")).alias("i"), casts.float_or_null(F.col("v")).alias("f"), casts.bool_or_null(F.col("v")).alias("b"), casts.str_or_null(F.col("v")).alias("s"))


@query("""with t as (select l_orderkey, l_linenumber, l_extendedprice * l_discount - 100 as x from lineitem), u as (select *, x * 100 as sc, trunc(x * 100) as w from t)
select l_orderkey, l_linenumber, case when sc - w = 0.5 then case when (w % 2 + 2) % 2 = 0 then w else w + 1 end when sc - w >= 0.5 then w + 1 else w end / 100 as rounded from u""")  # fmt: skip
def bankers_round(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select("l_orderkey", "l_linenumber", casts.bankers_round(F.col("l_extendedprice") * F.col("l_discount") - 100).alias("rounded"))


@query(r"""select page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '') as host,
url_decode(replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '+', '%2B')) as path, coalesce(url_decode(replace(regexp_extract(url, '[?&]id=([^&#]*)', 1), '+', '%20')), '') as id_param from pages""")  # fmt: skip
def url_parts(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"), urls.query_param(F.col("url"), "id").alias("id_param"))


@query("""with t as (select event_id, 'https://shop.example/p?b=' || (event_id % 7) || case when event_id % 2 = 0 then '&utm_source=x' else '' end || '&a=' || (event_id % 3) as u from events)
select event_id, case when event_id % 2 = 0 then 'https://shop.example/p?a=' || (event_id % 3) || '&b=' || (event_id % 7) else u end as stripped from t""")  # fmt: skip
def strip_params(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    u = F.concat(F.lit("https://shop.example/p?b="), i % 7, F.when(i % 2 == 0, "&utm_source=x").otherwise(""), F.lit("&a="), i % 3)
    return e.select("event_id", urls.strip_params(u).alias("stripped"))


_REF = ["", "https://www.google.de/search?q=red+shoes", "https://m.facebook.com/x", "https://news.example.org/a", "https://mail.other.net/in", "https://youtube.com/watch"]
_PAGE = ["https://shop.example/p", "https://shop.example/p?gclid=1", "https://shop.example/p?x=1&fbclid=9"]


@query("""with t as (select event_id, event_id % 6 as r, event_id % 7 as p from events)
select event_id,
case when p = 1 then 'google' when p = 2 then 'facebook' when p = 3 then 'news-letter' else case r when 0 then 'direct' when 1 then 'google' when 2 then 'facebook' when 3 then 'news.example.org' when 4 then 'mail.other.net' else 'youtube' end end as session_source,
case when p in (1, 2) then 'cpc' when r = 0 then 'none' when r = 1 then 'organic' when r = 2 then 'social' when r = 3 then 'referral' when r = 4 then 'email' else 'video' end as session_medium,
case when p not in (1, 2) and r = 1 then 'red-shoes' end as session_term from t""")  # fmt: skip
def attribution_rules(spark, sf_dir):
    i = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = e.select(
        "event_id", pick(_REF, i % 6).alias("page_referrer"), F.when(i % 7 < 3, pick(_PAGE, F.least(i % 7, F.lit(2)))).otherwise(F.lit(_PAGE[0])).alias("original_page_location"),
        F.lit(False).alias("ignore_referrer"), F.when(i % 7 == 3, "News Letter").alias("utm_source"), F.lit(None).cast("string").alias("utm_medium"), F.lit(None).cast("string").alias("utm_term"),
    )
    return attribution.attribute(first, attribution.referrer_table(spark)).select("event_id", "session_source", "session_medium", "session_term")


_KINDS = "['video', 'email', 'referral', 'social', 'ai', 'search']"


@query(f"""with t as (select event_id, event_id % 100 + 1 as k, event_id % 4 as m, {_KINDS}[(event_id % 100 + 1) % 6 + 1] as kind from events),
u as (select *, m < 2 or (m = 3 and k % 7 = 3) as found from t)
select event_id, case when m = 2 then 'mail.c' || k || '.test' when m = 3 and not found then 'x.s' || k || '.co.uk' when m = 3 then 's' || k when m = 1 and k % 10 = 0 then 'd' || k else 'n' || k end as session_source,
case when m = 2 then 'email' when not found then 'referral' when kind = 'search' then 'organic' else kind end as session_medium,
case when kind = 'search' and m = 0 then 'term-' || k when kind = 'search' and m = 1 then 't' end as session_term from u""")  # fmt: skip
def referrer_kinds(spark, sf_dir):
    """All kinds of referrers, by a list with a pattern or more for each customer: hosts, deeper hosts, and any ending."""
    k = F.col("c_custkey")
    kind = lambda k: F.get(F.array(*map(F.lit, ("video", "email", "referral", "social", "ai", "search"))), F.pmod(k, F.lit(6)).cast("int"))
    entry_of = lambda pattern, name, on: F.when(on, F.struct(pattern.alias("pattern"), kind(k).alias("kind"), name.alias("name"), F.lit("q").alias("terms")))
    of_customer = F.array(
        entry_of(F.concat(F.lit("c"), k, F.lit(".example")), F.concat(F.lit("n"), k), F.lit(True)), entry_of(F.concat(F.lit("deep.c"), k, F.lit(".example")), F.concat(F.lit("d"), k), k % 10 == 0),
        entry_of(F.concat(F.lit("s"), k, F.lit(".{}")), F.concat(F.lit("s"), k), k % 7 == 3),
    )
    table = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.inline(F.array_compact(of_customer)))
    i, n = F.col("event_id"), F.pmod("event_id", F.lit(100)) + 1
    m = F.pmod(i, F.lit(4))
    address = F.when(m == 0, F.concat(F.lit("https://www.c"), n, F.lit(".example/x?q=Term+"), n)).when(m == 1, F.concat(F.lit("https://deep.c"), n, F.lit(".example/?q=t"))).when(m == 2, F.concat(F.lit("https://mail.c"), n, F.lit(".test/"))).otherwise(F.concat(F.lit("https://x.s"), n, F.lit(".co.uk/")))
    first = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", address.alias("page_referrer"), F.lit("https://shop.example/p").alias("original_page_location"), F.lit(False).alias("ignore_referrer"))
    return attribution.attribute(first, table).select("event_id", "session_source", "session_medium", "session_term")


@query("""with hits as (select cast(event_id as varchar) as id, 'p' || (user_id % 3) as property_id, cast(user_id as varchar) as client_id, epoch_us(ts) as us from events),
marked as (select *, case when us - lag(us) over (partition by property_id, client_id order by us, id) > 43200000000 then 1 else 0 end as new from hits),
s as (select *, sum(new) over (partition by property_id, client_id order by us, id rows unbounded preceding) as seq from marked),
r as (select *, (row_number() over (partition by property_id, client_id, seq order by us, id) - 1) // 3 as part from s),
w as (select *, row_number() over z - 1 as n, count(*) over (partition by property_id, client_id, seq, part) as total, first_value(id) over z as first, first_value(us) over z as a, max(us) over (partition by property_id, client_id, seq, part) as b from r
  window z as (partition by property_id, client_id, seq, part order by us, id))
select id, property_id, client_id, cast(part as bigint) as split_idx, case when part > 0 then 'max_events_reached' end as session_split_cause, first as session_id, cast(n as bigint) as session_hit_number, total as session_total_events,
  cast(floor(b / 1000000) - floor(a / 1000000) as bigint) as session_duration from w""")  # fmt: skip
def stream_sessions(spark, sf_dir):
    """The hits as a stream of files, in time order: sessions leave it when they close, and in parts of three hits."""
    rows = hits(spark, sf_dir)
    bounds = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    folder = scratch_folder(spark, "stream")
    parts = 5
    placed = rows.join(F.broadcast(bounds)).withColumn("part", F.least(F.lit(parts - 1), F.floor((F.unix_micros("ts") - F.unix_micros("a")) * parts / (F.unix_micros("b") - F.unix_micros("a") + 1)))).drop("a", "b")
    beats = bounds.select(F.explode(F.sequence(F.lit(2), F.lit(6), F.lit(2))).alias("days"), "b").select(F.lit("p0").alias("property_id"), F.lit("clock").alias("client_id"), F.timestamp_micros(F.unix_micros("b") + F.col("days") * 86_400_000_000).alias("ts"), (F.col("days") / 2 + parts - 1).cast("int").alias("part"))
    placed = placed.withColumn("part", F.col("part").cast("int")).unionByName(beats, allowMissingColumns=True)
    placed.write.partitionBy("part").parquet(f"{folder}/placed")  # the input is read once, by all tasks
    staged = spark.read.schema(placed.schema).parquet(f"{folder}/placed")
    for i in range(parts + 3):  # one batch each
        staged.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{folder}/in/{i}")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    out = streaming.stream_sessions(source.drop("user_id", "value", "page_title"), 43_200, 0, streaming.Limits(10**9, 3))
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = spark.read.schema(out.schema).parquet(f"{folder}/out").where("not is_late")
    return closed.select("id", "property_id", "client_id", "split_idx", "session_split_cause", "session_id", "session_hit_number", "session_total_events", "session_duration")


@query("""select l_orderkey, round(sum(l_extendedprice * l_quantity), 2) as revenue, count(distinct l_partkey) as unique_items, cast(sum(cast(l_quantity as bigint)) as bigint) as total_quantity from lineitem group by l_orderkey""")
def items_revenue(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    item = F.concat(F.lit("pr"), "l_linenumber", F.lit("=id"), "l_partkey", F.lit("~pr"), "l_extendedprice", F.lit("~qt"), "l_quantity")
    orders = parsed(t.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(item)), "&").alias("q")), F.col("q")).withColumn("name", F.lit("purchase"))
    wanted = ("ecommerce_purchase_revenue", "ecommerce_unique_items", "ecommerce_items_total_quantity")
    made = projected(orders, ga4.columns(), *wanted)
    return made.select("l_orderkey", F.round("ecommerce_purchase_revenue", 2).alias("revenue"), F.col("ecommerce_unique_items").alias("unique_items"), F.col("ecommerce_items_total_quantity").alias("total_quantity"))


def projected(df: DataFrame, columns: list[ColumnDef], *names: str) -> DataFrame:
    """Some columns of a registry, with those they depend on."""
    registry = Registry(columns, given=pipeline.GIVEN)
    only, todo = set(), list(names)
    while todo:
        if (n := todo.pop()) in registry.columns and n not in only:
            only.add(n)
            todo += registry.columns[n].depends_on
    return registry.project(df, only=only)


def parsed(df: DataFrame, text: Column) -> DataFrame:
    """df with query_params from a query string."""
    return df.withColumn("query_params", urls.parse_query(text))


#: Half-even rounding to cents, for the oracles; {x} is the amount.
_CENTS = "case when {x} * 100 - trunc({x} * 100) = 0.5 then case when trunc({x} * 100) % 2 = 0 then trunc({x} * 100) else trunc({x} * 100) + 1 end when {x} * 100 - trunc({x} * 100) >= 0.5 then trunc({x} * 100) + 1 else trunc({x} * 100) end / 100"


@query(f"""with t as (select l_orderkey, l_linenumber, l_partkey, case l_linenumber % 3 when 0 then 'refund' when 1 then 'purchase' else 'add_to_cart' end as name, l_extendedprice as price,
  case when l_linenumber % 2 = 0 then 0 else l_quantity end as quantity, case l_orderkey % 4 when 0 then 'EUR' when 1 then 'usd' when 2 then 'xyz' end as currency from lineitem),
u as (select *, price * quantity as amount, case lower(currency) when 'eur' then 1.1e0 end as rate from t)
select l_orderkey, l_linenumber, 'P' || l_partkey as item_id, case when l_linenumber % 3 = 0 then 'own' when l_orderkey % 5 = 0 then 'list' end as item_list_id, price, quantity,
case when name = 'refund' then 0e0 else amount end as item_revenue, case when name = 'refund' then amount else 0e0 end as item_refund,
case when lower(currency) = 'usd' then price else {_CENTS.format(x='(price * rate)')} end as price_in_usd,
case when lower(currency) = 'usd' then case when name = 'refund' then 0e0 else amount end else {_CENTS.format(x="((case when name = 'refund' then 0e0 else amount end) * rate)")} end as item_revenue_in_usd,
case when name = 'purchase' then amount else 0e0 end as revenue, case when name = 'refund' then amount else 0e0 end as refund from u""")  # fmt: skip
def ga4_items(spark, sf_dir):
    """Item fields with dollars, refunds, missing quantities and fallbacks to the event's parameters."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    item = F.concat(F.lit("prx=id"), F.concat(F.lit("P"), "l_partkey"), F.lit("~pr"), "l_extendedprice", F.when(n % 2 == 0, "").otherwise(F.concat(F.lit("~qt"), "l_quantity")), F.when(n % 3 == 0, "~liown").otherwise(""), F.lit("&pr2=brNoName"))
    event = F.concat(item, F.when(o % 5 == 0, "&ep.item_list_id=list").otherwise(""), F.when(o % 4 == 0, "&ep.currency=EUR").when(o % 4 == 1, "&ep.currency=usd").when(o % 4 == 2, "&ep.currency=xyz").otherwise(""))
    hits = parsed(t.select("l_orderkey", "l_linenumber", F.when(n % 3 == 0, "refund").when(n % 3 == 1, "purchase").otherwise("add_to_cart").alias("name"), event.alias("q")), F.col("q"))
    hits = hits.withColumn("_usd_rate", F.when(o % 4 == 0, F.lit(1.1)))
    made = projected(hits, ga4.columns(with_rates=True), "ecommerce_items", "ecommerce_purchase_revenue", "ecommerce_refund_value")
    made = made.select("l_orderkey", "l_linenumber", F.explode_outer("ecommerce_items").alias("x"), F.col("ecommerce_purchase_revenue").alias("revenue"), F.col("ecommerce_refund_value").alias("refund")).where("x is not null")
    names = ("item_id", "item_list_id", "price", "quantity", "item_revenue", "item_refund", "price_in_usd", "item_revenue_in_usd")
    return made.select("l_orderkey", "l_linenumber", *[F.col(f"x.{c}").alias(c) for c in names], "revenue", "refund")


@query(SESSIONS + """select property_id, client_id, proto_seq, count(*) filter (where pv) >= 2 or count(*) filter (where name = 'purchase') >= 1 or bool_or(cast(id as bigint) % 7 = 0) as session_is_engaged from n group by all""")
def engaged_seg(spark, sf_dir):
    """The engagement flag of the request, through page flow and session values."""
    rows = parsed(sessions(spark, sf_dir), F.concat(F.lit("seg="), (F.col("id").cast("bigint") % 7 == 0).cast("int").cast("string")))
    rows = projected(rows, [c for c in ga4.columns() if c.name == "_seg"], "_seg")
    return session_totals.session_rows(page_flow.add_page_flow(rows)).select(*KEYS[:3], "session_is_engaged")


@query(SESSIONS + """select id, case when value < 10 then 'low' end as traffic_filter_name from n where not value > 60 and (cast(id as bigint) % 3 = 0 or name = 'view' or value >= 5)""")
def traffic_filter_numeric(spark, sf_dir):
    """Comparisons with numbers; conditions that fail on an event are skipped for it."""
    conditions = [
        filters.Condition("high", "exclude", "value > 60"), filters.Condition("no number", "exclude", "name > 5"), filters.Condition("no boolean", "exclude", "page_location"),
        filters.Condition("third", "allow", "id % 3 = 0"), filters.Condition("rest", "allow", "name = 'view' or value >= 5"), filters.Condition("low", "exclude", "value < 10", test_mode=True),
        filters.Condition("never", "exclude", "1 / (id - id) > 0", test_mode=True),
    ]
    return filters.apply_filters(hits(spark, sf_dir), conditions, ["id", "name", "value", "page_location"]).select("id", "traffic_filter_name")


@query("""with recursive h as (select cast(event_id as varchar) as id, user_id % 30 as g, epoch_us(ts) as us, case when event_id % 3 = 0 then 'u' || (event_id % 2) end as u, case when event_id % 4 = 0 then 'c' || (event_id % 5) end as c,
  row_number() over (partition by user_id % 30 order by ts, cast(event_id as varchar)) as i from events),
r as (select id, g, i, us as first, 1 as n, u, c, 0 as split_idx, cast(null as varchar) as cause from h where i = 1
union all select x.id, x.g, x.i, case when x.cause is null then x.first else x.us end, case when x.cause is null then x.n + 1 else 1 end,
  case when x.cause is null then coalesce(x.u, x.pu) else x.u end, case when x.cause is null then coalesce(x.c, x.pc) else x.c end, x.split_idx + case when x.cause is null then 0 else 1 end, x.cause
from (select h.id, h.g, h.i, h.us, h.u, h.c, r.first, r.n, r.u as pu, r.c as pc, r.split_idx,
  case when h.us - r.first >= 7200000000 then 'max_time_since_first_event_reached' when r.n >= 9 then 'max_events_reached' when h.u <> r.u then 'user_id_changed' when h.c <> r.c then 'utm_campaign_changed' end as cause
  from r join h on h.g = r.g and h.i = r.i + 1) x)
select id, cast(split_idx as bigint) as split_idx, cause as session_split_cause from r""")  # fmt: skip
def split_user_campaign(spark, sf_dir):
    """All four conditions together, each part with a context of its own."""
    i = F.col("id").cast("bigint")
    rows = hits(spark, sf_dir).withColumns({"g": F.pmod(F.col("user_id").cast("bigint"), F.lit(30)), "user_id": F.when(i % 3 == 0, F.concat(F.lit("u"), i % 2)), "utm_campaign": F.when(i % 4 == 0, F.concat(F.lit("c"), i % 5))})
    cut = sessionize.split(rows, max_s=7_200, max_events=9, group=["g"])
    return cut.select("id", "split_idx", F.col("_split_cause").alias("session_split_cause"))


def matomo_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a Matomo tracker: two of three carry one hit in the address, the others two hits in a bulk body."""
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    base = F.concat(F.lit("idsite=7&_id=v"), "user_id", F.lit("&url="), F.url_encode(F.concat(F.lit("https://shop.example/p/"), k)), F.lit("&action_name=T+"), k)
    kind = F.when(k % 8 == 0, "&idgoal=0&ec_id=O1&revenue=12.5").when(k % 8 == 1, "&idgoal=3").when(k % 8 == 2, "&search=").when(k % 8 == 3, "&e_c=c&e_a=a&e_v=1.5").when(k % 8 == 4, "&c_n=n").when(k % 8 == 5, "&ma_id=1&ma_mt=video").when(k % 8 == 6, "&e_c=c").otherwise("&c_n=n&c_i=x")
    one = F.concat(base, kind, F.when(i % 2 == 0, "&uid=u1").otherwise("&uid="))
    bulk = F.concat(F.lit('{"requests":["?'), one, F.lit('","?'), base, F.lit('&link=https%3A%2F%2Fx.example"]}'))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        i.cast("string").alias("request_id"), F.col("ts").cast("timestamp").alias("server_received_time"), F.when(i % 3 == 0, "").otherwise(one).alias("query"), F.when(i % 3 == 0, bulk).otherwise("").alias("body"),
        F.lit("shop.example").alias("host"), F.lit("/matomo.php").alias("path"), F.lit("POST").alias("method"), F.lit("10.0.0.1").alias("ip_address"), F.create_map(F.lit("User-Agent"), F.array(F.lit("x"))).alias("headers"),
    )


@query("""with e as (select event_id, user_id, cast(json_extract_string(props, '$.k') as int) as k from events),
h as (select *, 0 as line from e union all select *, 1 as line from e where event_id % 3 = 0)
select sha256(event_id || '|' || line) as id, 'v' || user_id as client_id, 'shop' as property_id, case when line = 0 and event_id % 2 = 0 then 'u1' end as user_id,
case when line = 1 then 'outlink' else case k % 8 when 0 then 'ecommerce_order' when 1 then 'goal_conversion' when 2 then 'site_search' when 3 then 'custom_event' when 4 then 'content_impression' when 5 then 'video_play' when 6 then 'page_view' else 'content_interaction' end end as name,
'https://shop.example/p/' || k as page_location, 'T ' || k as page_title, case when line = 0 and k % 8 = 0 then 12.5e0 end as ecommerce_purchase_revenue, case when line = 0 and k % 8 = 3 then 1.5e0 end as params_value from h""")  # fmt: skip
def matomo_events(spark, sf_dir):
    """Bulk explode, keys, property by site id, event names and typed parameters."""
    settings = spark.createDataFrame([("7", "shop", "Shop", "matomo"), ("8", "other", "Other", "ga4")], "site_id string, property_id string, property_name string, property_protocol string")
    rows = pipeline.hits_from_requests(matomo_requests(spark, sf_dir), "matomo", settings)
    wanted = ("page_location", "page_title", "ecommerce_purchase_revenue", "params_value")
    return projected(rows, matomo.columns(), *wanted).select("id", "client_id", "property_id", "user_id", "name", *wanted)


@query("""select l_orderkey, l_linenumber, case when l_linenumber = 4 then 'true' else cast(l_partkey as varchar) end as item_id, case when l_linenumber = 3 then '' else 'N' end as item_name,
case when l_linenumber = 2 then '' else 'a' end as item_category, case when l_linenumber % 2 = 1 then 'b' end as item_category2, case when l_linenumber = 5 then 0e0 else l_extendedprice end as price, case when l_linenumber = 6 then 1e0 else l_quantity end as quantity
from lineitem where l_linenumber < 7""")  # fmt: skip
def matomo_items(spark, sf_dir):
    """Orders' items of mixed types in one JSON array; items without a sku, and events with bad JSON, are left out."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.col("l_linenumber")
    sku = F.when(n == 1, F.concat(F.lit('"'), "l_partkey", F.lit('"'))).when(n == 4, "true").when(n == 7, '""').otherwise(F.col("l_partkey").cast("string"))
    name = F.when(n == 3, "5").otherwise('"N"')
    category = F.when(n == 2, "null").when(n % 2 == 1, '["a", "b", 3]').otherwise('"a"')
    price, quantity = F.when(n == 5, '"9.5"').otherwise(F.col("l_extendedprice").cast("string")), F.when(n == 6, "null").otherwise(F.col("l_quantity").cast("string"))
    text = F.concat(F.lit("[["), F.concat_ws(",", sku, name, category, price, quantity), F.lit('],[],"x"]'))
    rows = t.withColumn("query_params", F.create_map(F.lit("ec_items"), F.array(text)))
    bad = t.where("l_linenumber = 1").withColumn("query_params", F.create_map(F.lit("ec_items"), F.array(F.lit("[[1,"))))
    made = projected(rows.unionByName(bad), matomo.columns(), "ecommerce_items", "_items_readable").where("_items_readable")
    names = ("item_id", "item_name", "item_category", "item_category2", "price", "quantity")
    return made.select("l_orderkey", "l_linenumber", F.explode_outer("ecommerce_items").alias("x")).where("x is not null").select("l_orderkey", "l_linenumber", *[F.col(f"x.{c}").alias(c) for c in names])


@query("""select event_id, 'a=1;b=' || user_id as variables, '2=last;10=ten' as dimensions, case when event_id % 2 = 0 then 'x' end as category1, case when event_id % 2 = 0 then 'y' else null end as category2 from events""")
def matomo_variables(spark, sf_dir):
    """Custom variables, dimensions and page categories; pairs in the order of their slots."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pairs = F.concat(F.lit('{"10":["b","'), "user_id", F.lit('"],"9":["a","1"],"3":["only"]}'))
    even = F.col("event_id") % 2 == 0
    more = F.when(even, F.map_from_arrays(F.array(F.lit("_pkc")), F.array(F.array(F.lit('["x","y"]'))))).otherwise(F.map_from_arrays(F.array(F.lit("_pkc")), F.array(F.array(F.lit("")))))
    given = F.map_from_arrays(F.array(F.lit("cvar"), F.lit("dimension10"), F.lit("dimension2"), F.lit("dimension3"), F.lit("dimensionx")), F.array(F.array(pairs), F.array(F.lit("ten")), F.array(F.lit("first"), F.lit("last")), F.array(F.lit("")), F.array(F.lit("z"))))
    made = projected(e.withColumn("query_params", F.map_concat(given, more)), matomo.columns(), "custom_variables", "custom_dimensions", "params_product_category_1", "params_product_category_2")
    return made.select(
        "event_id", F.array_join(F.transform("custom_variables", lambda x: F.concat_ws("=", x["name"], x["value"])), ";").alias("variables"), F.array_join(F.transform("custom_dimensions", lambda x: F.concat_ws("=", x["slot"].cast("string"), x["value"])), ";").alias("dimensions"),
        F.col("params_product_category_1").alias("category1"), F.col("params_product_category_2").alias("category2"),
    )


@query("""select event_id, concat_ws(',', case when event_id % 2 = 0 then 'client_id' end, case when event_id % 3 = 0 then 'name' end, case when event_id % 5 = 0 then 'headers' end, case when event_id % 7 = 0 then 'body' end, case when event_id % 11 = 0 then 'size' end, case when event_id % 13 = 0 then 'protocol' end) as errors from events""")
def validate_hits(spark, sf_dir):
    i = F.col("event_id")
    none = F.lit(None).cast("map<string,array<string>>")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.when(i % 2 == 0, "").otherwise("c").alias("client_id"), F.lit("p").alias("property_id"), F.when(i % 3 != 0, "n").alias("name"), F.lit("h").alias("host"), F.lit("/").alias("path"), F.lit("GET").alias("method"),
        F.when(i % 5 == 0, none).otherwise(F.create_map(F.lit("A"), F.array(F.lit("b")))).alias("headers"), F.create_map(F.lit("q"), F.array(F.when(i % 11 == 0, F.repeat(F.lit("x"), 3000)).otherwise("x"))).alias("query_params"),
        F.when(i % 7 != 0, "").alias("body"), F.when(i % 13 == 0, "matomo").otherwise("ga4").alias("property_protocol"),
    )
    return requests.with_errors(rows, 2000, "ga4").select("event_id", F.array_join("errors", ",").alias("errors"))


@query("""select event_id, '10.' || (user_id % 256) || '.' || (event_id % 256) || '.0' as m1, '10.' || (user_id % 256) || '.0.0' as m2, '10.0.0.0' as m3, '0.0.0.0' as m4, '10.' || (user_id % 256) || '.' || (event_id % 256) || '.7' as m9,
'2001:db8:' || lower(to_hex(event_id % 65535 + 1)) || '::' as six from events""")  # fmt: skip
def mask_ip(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ip = F.concat(F.lit("10."), F.col("user_id") % 256, F.lit("."), F.col("event_id") % 256, F.lit(".7"))
    six = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("event_id") % 65535 + 1)), F.lit("::1:2"))
    return e.select("event_id", *[addresses.mask_ip(ip, n).alias(f"m{n}") for n in (1, 2, 3, 4, 9)], addresses.mask_ip(six, 1).alias("six"))


@query("""select event_id, case when event_id % 2 = 1 then 'peer' when event_id % 3 = 0 then 'real' when event_id % 5 = 0 then 'cf' when event_id % 7 = 0 then 'first' else 'peer' end as client from events""")
def real_ip(spark, sf_dir):
    i = F.col("event_id")
    head = lambda name, on, text: F.when(on, F.map_from_arrays(F.array(F.lit(name)), F.array(F.array(F.lit(text))))).otherwise(F.map_from_arrays(F.array(F.lit(name)), F.array(F.array(F.lit("")))))
    headers = F.map_concat(head("X-Real-IP", i % 3 == 0, "real"), head("CF-Connecting-IP", i % 5 == 0, "cf"), head("X-Forwarded-For", i % 7 == 0, " , first, second"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", addresses.real_ip(headers, F.lit("peer"), i % 2 == 0).alias("client"))


@query("""select event_id, 'a:x,a:y,b:' || case when event_id % 2 = 0 then '' else '1.5' end || ',z:' || user_id as params from events where event_id % 2 = 1 union all select event_id, 'a:x,a:y,z:' || user_id as params from events where event_id % 2 = 0""")
def params_array(spark, sf_dir):
    """Every ep. and numeric epn. parameter, all values, by name."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = parsed(e, F.concat(F.lit("ep.z="), "user_id", F.lit("&ep.a=x&v=2&ep.a=y&epn.b="), F.when(F.col("event_id") % 2 == 0, "no").otherwise("1.5")))
    made = projected(rows, ga4.columns(), "params")
    return made.select("event_id", F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["value_string"], p["value_number"].cast("string")))), ",").alias("params"))


@query(SESSIONS + """, d as (select property_id, client_id, proto_seq, rn, cast(id as bigint) % 4 as slot, id as v from n where cast(id as bigint) % 3 <> 0),
l as (select property_id, client_id, proto_seq, slot, arg_max(v, rn) as v from d group by all), m as (select property_id, client_id, proto_seq, string_agg(slot || '=' || v, ';' order by slot) as merged from l group by all)
select n.id, m.merged from n left join m using (property_id, client_id, proto_seq)""")  # fmt: skip
def merged_dimensions(spark, sf_dir):
    """The last value of each slot in a session, on every event of it."""
    i = F.col("id").cast("bigint")
    rows = sessions(spark, sf_dir).withColumn("d", F.when(i % 3 != 0, F.array(F.struct((i % 4).alias("slot"), F.col("id").alias("value")))).otherwise(F.array().cast("array<struct<slot:bigint,value:string>>")))
    made = session_totals.merged_on_every_event(rows, "d", "slot", "value", "m")
    return made.select("id", F.when(F.col("m").isNotNull(), F.array_join(F.transform("m", lambda x: F.concat(x["slot"].cast("string"), F.lit("="), x["value"])), ";")).alias("merged"))


@query("""select lower(n_name) as base, 'usd' as quote, n_nationkey + 1.5 as rate from nation""")
def latest_rates(spark, sf_dir):
    """The newest snapshot that holds rates."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rates = lambda add: n.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit(" "), "n_name"), F.map_from_arrays(F.array(F.lit("USD ")), F.array((F.col("n_nationkey") + add).cast("double")))))).alias("rates"))
    old, new = rates(0.5).withColumn("created_at", F.lit("2024-01-01").cast("timestamp")), rates(1.5).withColumn("created_at", F.lit("2024-02-01").cast("timestamp"))
    empty = new.select(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<map<string,double>>")).alias("rates"), F.lit("2024-03-01").cast("timestamp").alias("created_at"))
    return lookups.latest_rates(old.unionByName(new).unionByName(empty))


#: A user agent with its Sec-Ch-Ua-Platform hint, and what is told from them: kind, brand, model, system, its version, browser, its version.
_AGENTS = [
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 16_5 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.5 Mobile/15E148 Safari/604.1", None, ("smartphone", "Apple", "iPhone", "iOS", "16.5", "Mobile Safari", "16.5")),
    ("Mozilla/5.0 (Linux; Android 13; SM-S911B Build/TP1A) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/116.0.0.0 Mobile Safari/537.36", None, ("smartphone", "Samsung", "SM-S911B", "Android", "13", "Chrome Mobile", "116.0.0.0")),
    ("Mozilla/5.0 (Windows NT 6.1; Win64; x64; rv:115.0) Gecko/20100101 Firefox/115.0", None, ("desktop", None, None, "Windows", "7", "Firefox", "115.0")),
    ("Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/141.0.0.0 Safari/537.36", '"macOS"', ("desktop", None, None, "Mac", None, "Chrome", "141.0.0.0")),
    ("Mozilla/5.0 (compatible; Examplebot/2.1; +http://bot.example/)", None, ("bot", "Examplebot", None, None, None, None, None)),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.91", None, ("desktop", None, None, "Mac", "10.15.7", "Microsoft Edge", "120.0.2210.91")),
]
_DEVICE_SQL = ", ".join(f"case event_id % 6 {' '.join(f'when {i} then ' + repr(a[2][k]) for i, a in enumerate(_AGENTS) if a[2][k])} end as {name}" for k, name in enumerate(lookups.DEVICE))


@query(f"select event_id, {_DEVICE_SQL} from events")
def device_columns(spark, sf_dir):
    """Devices, systems and browsers of user agents and client hints."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % 6 + 1).cast("int"))
    agent, hint = pick([a for a, _, _ in _AGENTS]), pick([h or "" for _, h, _ in _AGENTS])
    rows = e.withColumn("headers", F.map_from_arrays(F.array(F.lit("User-Agent"), F.lit("Sec-Ch-Ua-Platform")), F.array(F.array(agent), F.array(hint))))
    return lookups.with_device(rows).drop("headers")


@query(f"""select event_id, '{pipeline.NATIVE}' as tracking_protocol, 'web' as platform, 'https://n.example/p' || (event_id % 3) || '?k=1' as page_location, 'n.example' as page_hostname, '/p' || (event_id % 3) as page_path,
case when event_id % 2 = 0 then 'spring' end as utm_campaign, case when event_id % 2 = 1 then 'g1' end as click_id_gclid, case when event_id % 2 = 0 then true else false end as privacy_analytics_storage, 'pl' as device_language from events""")  # fmt: skip
def native_events(spark, sf_dir):
    """The native protocol: the columns of GA4 under its own name; campaign and click ids from the page's original address."""
    i = F.col("event_id")
    page = F.concat(F.lit("https://n.example/p"), i % 3, F.lit("?k=1"), F.when(i % 2 == 0, "&utm_campaign=spring").otherwise("&gclid=g1"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("cid=1&tid=D-1&en=page_view&ul=&gcs=G1"), F.when(i % 2 == 0, "11").otherwise("10"), F.lit("&dl="), F.url_encode(page)).alias("q"))
    rows = parsed(e, F.col("q")).withColumn("headers", F.create_map(F.lit("Accept-Language"), F.array(F.lit("pl"))))
    wanted = ("tracking_protocol", "platform", "page_location", "page_hostname", "page_path", "utm_campaign", "click_id_gclid", "privacy_analytics_storage", "device_language")
    return projected(rows, pipeline.protocol_of("native").columns(False, urls.EXCLUDED_PARAMS), *wanted).select("event_id", *wanted)


@query("""with t as (select event_id, event_id % 4 as m, user_id % 16 as u from events) select event_id, case when m = 0 then 'wide' when m = 1 then 'narrow' when m = 2 then 'v4' end as geo_city from t""")
def ip_range_both_families(spark, sf_dir):
    """Ranges of both families given as addresses, one inside another."""
    ranges = spark.createDataFrame([("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "wide"), ("2001:db8:5::", "2001:db8:5:ffff:ffff:ffff:ffff:ffff", "narrow"), ("10.0.0.0", "10.0.0.255", "v4")], "lo string, hi string, geo_city string")
    u = F.lower(F.hex(F.col("user_id") % 16))
    ip = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("2001:db8:9::"), u)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("2001:DB8:5:1:2:3:4:"), u)).when(F.col("event_id") % 4 == 2, F.concat(F.lit("10.0.0."), F.col("user_id") % 16)).otherwise("fe80::1")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ip.alias("ip_address"))
    return lookups.ip_ranges(e, ranges).select("event_id", "geo_city")


@query("""with r(b, r) as (values ('eur', 1.1), ('pln', 0.25)), t as (select o_orderkey, o_totalprice as v, case o_orderkey % 4 when 0 then ' EUR' when 1 then 'usd' when 2 then 'PLN' else 'xyz' end as c from orders),
u as (select t.*, r.r, v * r.r * 100 as sc, trunc(v * r.r * 100) as w from t left join r on r.b = lower(trim(c)))
select o_orderkey, case when lower(trim(c)) = 'usd' then v when r is null then null else case when sc - w = 0.5 then case when w % 2 = 0 then w else w + 1 end when sc - w >= 0.5 then w + 1 else w end / 100 end as in_usd from u""")  # fmt: skip
def fx_convert(spark, sf_dir):
    i = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("v"), F.when(i % 4 == 0, " EUR").when(i % 4 == 1, "usd").when(i % 4 == 2, "PLN").otherwise("xyz").alias("c"))
    rates = spark.createDataFrame([("eur", "usd", 1.1), ("pln", "usd", 0.25)], "base string, quote string, rate double")
    return lookups.convert(o, rates, "v", "c", "usd", "in_usd").select("o_orderkey", "in_usd")


@query("""with r as (select n_nationkey, n_name, n_nationkey * 10000000 as lo, n_nationkey * 10000000 + 4999999 as hi from nation), t as (select event_id, (event_id * 7919) % 260000000 as a from events)
select event_id, r.n_name as geo_country from t left join r on a between lo and hi""")  # fmt: skip
def ip_range_join(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lo = F.col("n_nationkey").cast("bigint") * 10_000_000
    ranges = n.select(lo.alias("lo"), (lo + 4_999_999).alias("hi"), F.col("n_name").alias("geo_country"))
    a = (F.col("event_id") * 7919) % 260_000_000
    part = lambda s: (F.shiftright(a, s) % 256).cast("string")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat_ws(".", part(24), part(16), part(8), part(0)).alias("ip_address"))
    return lookups.ip_ranges(e, ranges).select("event_id", "geo_country")


@query("""select event_id, case when event_id % 3 = 0 then user_id end as answer from events""")
def custom_column_lookup(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    row = lambda k, v: F.struct(F.lit(k).alias("name"), v.cast("double").alias("value_number"))
    params = F.array(row("a", F.col("event_id")), F.when(F.col("event_id") % 3 == 0, row("b", F.col("user_id"))).otherwise(row("c", F.lit(1))), row("b", F.lit(None)))
    return e.select("event_id", lookups.nested_lookup(params, "name", "b", "value_number", "bigint").alias("answer"))


@query(SESSIONS + """, z as (select property_id, client_id, proto_seq, count(*) as session_total_events, arg_min(id, (us, id)) as session_id from n group by all) select n.id, z.session_id, z.session_total_events from n join z using (property_id, client_id, proto_seq)""")
def embedded_layout(spark, sf_dir):
    return session_totals.windowed_totals(sessions(spark, sf_dir)).select("id", "session_id", "session_total_events")


@query("""select n_nationkey as k, n_name as name, cast(null as varchar) as segment from nation union all by name select c_nationkey as k, cast(null as varchar) as name, c_mktsegment as segment from customer""")
def schema_union(spark, sf_dir):
    """Rows of two layouts brought to the union of their columns."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return in_one_layout(n, c)


@query("""with t as (select event_id, user_id % 3 as property_id, cast(floor(epoch_us(ts) / 1000000) as bigint) as s, event_id as arrival from events),
u as (select *, max(s) over (partition by property_id order by arrival, event_id rows between unbounded preceding and 1 preceding) as clock from t) select event_id, coalesce(s + 1800 <= clock, false) as is_late from u""")  # fmt: skip
def late_drop(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("user_id") % 3).alias("property_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("arrival"))
    return sessionize.drop_late(e, tie="event_id").select("event_id", "is_late")


@query(SESSIONS + """, q as (select *, case when cast(id as bigint) % 4 = 0 then null else 'st' || (cast(id as bigint) % 50) end as stamp from hits),
g as (select *, case when us - lag(us) over w > 1800000000 then 1 else 0 end as g from q window w as (partition by property_id, stamp order by us, id)),
r as (select *, sum(g) over (partition by property_id, stamp order by us, id rows unbounded preceding) as run from g)
select id, case when stamp is null then client_id else first_value(client_id) over (partition by property_id, stamp, run order by us, id) end as stitched_client_id from r""")  # fmt: skip
def stitch_by_stamp(spark, sf_dir):
    i = F.col("id").cast("bigint")
    rows = hits(spark, sf_dir).withColumn("session_stamp", F.when(i % 4 != 0, F.concat(F.lit("st"), (i % 50).cast("string"))))
    return sessionize.stitch_by_stamp(rows).select("id", "stitched_client_id")


@query()
def stitch_identity(spark, sf_dir):
    """Stamps and user ids together: an online rule that SQL can't express; tests hold it against scenarios."""
    i = F.col("id").cast("bigint")
    rows = hits(spark, sf_dir).withColumns({"session_stamp": F.when(i % 4 != 0, F.concat(F.lit("st"), (i % 50).cast("string"))), "user_id": F.when(i % 5 == 0, F.concat(F.lit("u"), (i % 40).cast("string")))})
    return sessionize.stitch(rows).select("id", "stitched_client_id")


@query(SESSIONS + """, w as (select property_id, client_id, name, count(*) as n_events, count(distinct proto_seq) as n_sessions from n group by all) select * from w""")
def events_by_name(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    return rows.groupBy("property_id", "client_id", "name", "proto_seq").agg(F.count("*").alias("c")).groupBy("property_id", "client_id", "name").agg(F.sum("c").alias("n_events"), F.count("*").alias("n_sessions"))


@query("""select sha256('p' || (user_id % 3) || '|' || user_id) as isolated, count(*) as n from events group by all""")
def isolated_ids(spark, sf_dir):
    return hits(spark, sf_dir).groupBy(sessionize.isolated_id("property_id", "client_id").alias("isolated")).agg(F.count("*").alias("n"))


def ga4_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as a browser would send the events."""
    h = hits(spark, sf_dir)
    en = lambda c: F.url_encode(c)
    q = F.concat(F.lit("v=2&tid=G-1&cid="), "client_id", F.lit("&en="), "name", F.lit("&dl="), en(F.concat(F.lit("https://shop.example"), "page_location", F.lit("?utm_source=news&id=1"))), F.lit("&dt="), F.coalesce("page_title", F.lit("")), F.lit("&epn.value="), F.col("value").cast("string"), F.lit("&ep.currency=EUR&pr1=idA1~nmShoe~pr2.5~qt2&sct=2"))
    ua = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"
    return h.select(
        F.col("id").alias("request_id"), F.col("ts").alias("server_received_time"), q.alias("query"), F.lit("").alias("body"), F.lit("shop.example").alias("host"), F.lit("/g/collect").alias("path"), F.lit("POST").alias("method"),
        F.lit("10.0.0.1").alias("ip_address"), F.create_map(F.lit("User-Agent"), F.array(F.lit(ua))).alias("headers"), "property_id",
    )


@query(SESSIONS + """select sha256(n.id || '|0') as id, cast(rn as bigint) as session_hit_number, count(*) over (partition by property_id, client_id, proto_seq) as session_total_events,
'https://shop.example' || page_location || '?id=1' as page_location, coalesce(page_title, '') as page_title, 'news' as session_source, value as params_value, 'Chrome' as device_web_browser,
case when name = 'purchase' then 5e0 else 0e0 end as ecommerce_purchase_revenue from n""")  # fmt: skip
def wide_events(spark, sf_dir):
    """The whole way: requests, hits, event columns, sessions, page flow, session values, attribution."""
    raw = ga4_requests(spark, sf_dir)
    wide = pipeline.build_events(pipeline.hits_from_requests(raw), pipeline.Options(), attribution.referrer_table(spark), clients=pipeline.clients_of(raw))
    return wide.select("id", "session_hit_number", "session_total_events", "page_location", "page_title", "session_source", F.col("params_value"), "device_web_browser", "ecommerce_purchase_revenue")


@query(SESSIONS + """, x as (select *, cast(substr(page_location, 4) as int) as k from n),
v as (select *, case when k % 4 > 0 then 'pl' || (k % 4) end as plan, 'c' || (k % 5) as campaign from x),
w as (select *, last_value(plan ignore nulls) over z as session_plan, last_value(plan) over z as last_plan, bool_or(k % 3 >= 2) over z as returning_user, count(*) over z as total,
  first_value(case when pv then campaign end ignore nulls) over z as session_campaign, first_value(case when pv then id end ignore nulls) over z as page_id
  from v window z as (partition by property_id, client_id, proto_seq order by us, id rows between unbounded preceding and unbounded following))
select sha256(id || '|0') as id, cast(rn as bigint) as session_hit_number, total as session_total_events, cast(floor(us / 1000000) as bigint) as timestamp_s, strftime(make_timestamp(us), '%Y-%m-%d') as date_utc,
  'Shop ' || property_id as property_name, cast(floor(us / 1000000) as bigint) as page_load_s, returning_user as session_returning_user, session_plan, last_plan as last_event_plan, session_campaign as session_utm_campaign,
  cast(null as varchar) as geo_metro, 'en-gb' as device_language, plan, k % 2 = 0 as consent from w where k % 11 > 0""")  # fmt: skip
def wide_sessions(spark, sf_dir):
    """Columns of all scopes from requests: custom ones, first and last values, returning users, dates, properties; broken events go, and
    count in their session."""
    h = hits(spark, sf_dir)
    k = F.substring("page_location", 4, 9).cast("int")
    page = F.concat(F.lit("https://shop.example/p"), F.when(k % 11 == 0, "/%zz").otherwise(""), F.lit("?utm_campaign=c"), k % 5)
    plan = F.when(k % 4 > 0, F.concat(F.lit("&ep.plan=pl"), k % 4)).otherwise("")
    q = F.concat(F.lit("v=2&ul=en-gb&tid=G-"), "property_id", F.lit("&cid="), "client_id", F.lit("&en="), "name", F.lit("&dl="), F.url_encode(page), F.lit("&sct="), k % 3, F.lit("&_p="), F.unix_millis("ts"), plan, F.lit("&gcs=G1"), (1 - k % 2), F.lit("1"))
    raw = h.select(
        F.col("id").alias("request_id"), F.col("ts").alias("server_received_time"), q.alias("query"), F.lit("").alias("body"), F.lit("shop.example").alias("host"), F.lit("/g/collect").alias("path"), F.lit("POST").alias("method"),
        F.lit("10.0.0.1").alias("ip_address"), F.create_map(F.lit("User-Agent"), F.array(F.lit("x"))).alias("headers"),
    )
    settings = h.select(F.concat(F.lit("G-"), "property_id").alias("measurement_id"), "property_id", F.concat(F.lit("Shop "), "property_id").alias("property_name"), F.lit("ga4").alias("property_protocol")).distinct()
    wanted = [{"name": "plan", "parameter": "plan"}, {"name": "session_plan", "scope": "session", "parameter": "plan"}]
    custom = [*columns.custom_columns(wanted, ga4.custom_param), shared_columns.session_param("last_event_plan", "ep.plan")]
    good = pipeline.accepted(pipeline.hits_from_requests(raw, "ga4", settings, max_bytes=131_072))
    wide = pipeline.build_events(good, pipeline.Options(custom=custom, with_device=False, split=False), clients=pipeline.clients_of(raw))
    return wide.select(
        "id", "session_hit_number", "session_total_events", F.unix_seconds("timestamp_utc").alias("timestamp_s"), F.date_format("date_utc", "yyyy-MM-dd").alias("date_utc"), "property_name", F.unix_seconds("page_load_hash").alias("page_load_s"),
        "session_returning_user", "session_plan", "last_event_plan", "session_utm_campaign", "geo_metro", "device_language", "plan", F.col("privacy_ads_storage").alias("consent"),
    )


@query("""with t as (select event_id, event_id % (select count(*) from part) + 1 as k, event_id % 5 as m from events)
select event_id, case when m = 4 then 'bot' when m = 3 then 'desktop' when k % 3 = 0 then 'tablet' else 'smartphone' end as device_category, case when m = 4 then 'Bot ' || k when m = 3 then null else 'Maker ' || (k % 25) end as device_mobile_brand_name,
  case when m < 3 then case when m = 1 then 'hinted' else 'Model ' || k end end as device_mobile_model_name, case when m = 4 then null when m = 3 then 'Windows' else 'Android' end as device_operating_system,
  case when m = 3 then '10' when m < 3 then '1' || (k % 4) end as device_operating_system_version, case when m = 4 then null when m = 2 then 'Browser ' || k when m = 3 then 'Chrome' else 'Chrome Mobile' end as device_web_browser,
  case when m = 2 then '7.' || k when m < 4 then '120.0.0.0' end as device_web_browser_version from t""")  # fmt: skip
def device_agents(spark, sf_dir):
    """A database with four patterns for each part: makers and models, browsers, bots, and one system."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") + 1).alias("k"))
    k = F.col("k")
    row = lambda section, regex, name, version=F.lit(None), brand=F.lit(None), device=F.lit(None): F.struct(F.lit(section).alias("section"), k.cast("int").alias("place"), regex.alias("regex"), name.alias("name"), version.cast("string").alias("version"), brand.cast("string").alias("brand"), device.cast("string").alias("device"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    database = part.select(F.inline(F.array(
        row("model", text("(?:^|[^A-Z0-9])mx-(", k, r")[a-f](?:[);/ ]|$)"), F.lit("Model $1"), brand=text("Maker ", k % 25), device=F.when(k % 3 == 0, "tablet").otherwise("phablet")),
        row("browser", text("surf", k, r"/(\d+[.\d]*)"), text("Browser ", k), F.lit("$1")),
        row("bot", text("crawl", k, r"(?:er)?/\d"), text("Bot ", k)), row("system", text(r"Android (\d+)[;)] (?:.*)X", k, r"Y?\b"), F.lit("Android"), F.lit("$1")),
    )))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").crossJoin(F.broadcast(part.agg(F.count("*").alias("parts")))).select("event_id", (F.pmod("event_id", "parts") + 1).alias("k"), F.pmod("event_id", F.lit(5)).alias("m"))
    phone = lambda more: text("Mozilla/5.0 (Linux; Android 1", k % 4, "; MX-", k, "b) X", k, "Y", more)
    chrome = F.lit(" AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Mobile Safari/537.36")
    agent = F.when(F.col("m") == 4, text("Crawl", k, "er/2.0 (+https://x.example)")).when(F.col("m") == 3, "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36")
    agent = agent.when(F.col("m") == 2, phone(text(chrome, " Surf", k, "/7.", k))).otherwise(phone(chrome))
    hints = F.when(F.col("m") == 1, F.create_map(F.lit("User-Agent"), F.array(agent), F.lit("Sec-Ch-Ua-Model"), F.array(F.lit('"hinted"')))).otherwise(F.create_map(F.lit("User-Agent"), F.array(agent)))
    return devices.with_device(e.select("event_id", hints.alias("headers")), database).drop("headers")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: the wide row of each event."""
    raw = ga4_requests(spark, sf_dir)
    return pipeline.build_events(pipeline.hits_from_requests(raw), pipeline.Options(), attribution.referrer_table(spark), clients=pipeline.clients_of(raw))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


