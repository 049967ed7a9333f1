"""Scalar functions, column registry, requests, protocols, lookups, sinks, streaming."""

import dataclasses
import datetime as dt

import pytest
from hitloom.functions import addresses, casts, urls
from hitloom.operators import attribution, lookups
from hitloom.plans import columns, pipeline
from hitloom.plans.columns import ColumnDef, Registry, missing_columns
from hitloom.sources import ga4, matomo, requests, shared_columns, sinks
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("v,want", [("5", 5), (" 5", None), ("+7", 7), ("", None), ("1.0", None), (None, None), ("99999999999999999999", None)])
def test_int(spark, v, want):
    assert one(spark, v, casts.int_or_null) == want


@pytest.mark.parametrize("v,want", [("1.5", 1.5), (".5", 0.5), ("5d", None), ("1e3", 1000.0), ("", None), (" 1", None)])
def test_float(spark, v, want):
    assert one(spark, v, casts.float_or_null) == want


@pytest.mark.parametrize("v,want", [(1.015, 1.01), (2.5, 2.5), (0.125, 0.12), (0.375, 0.38), (-1.239, -1.23), (3.0, 3.0)])
def test_bankers_round(spark, v, want):
    assert one(spark, v, casts.bankers_round, "double") == pytest.approx(want)


@pytest.mark.parametrize("u,host,path,a", [("https://u:p@Shop.example:8080/a%20b/c+d?a=1+2&a=3#x", "Shop.example", "/a b/c+d", "1 2"), ("http://[2001:db8::1]:80/x?b=1", "2001:db8::1", "/x", ""), ("/only/path?a=%zz&a=2", "", "/only/path", ""), ("https://h/p q?a=ü", "h", "/p q", "ü")])
def test_urls(spark, u, host, path, a):
    assert one(spark, u, urls.host) == host
    assert one(spark, u, urls.path) == path
    assert one(spark, u, lambda c: urls.query_param(c, "a")) == a


@pytest.mark.parametrize("u,ok", [
    ("", True), ("https://h.example/a%20b?x=%zz#f", True), ("/only/path?a=b:c", True), ("a/b:c", True), ("http://[2001:db8::1]:80/x", True), ("mailto:x y%zz", True), ("https://u:p%40@h:8080/", True), ("//h.example/x", True), ("http://bücher.example/", True), ("x" * 20_000 + "%41" * 3000, True),
    ("https://h/%zz", False), ("https://h/a%2", False), ("https://h:8a/", False), ("https://h h/", False), ("1:b/c", False), (":x", False), ("https://h/x\ty", False), ("https://h/#%q", False), ("http://[::1/x", False), ("https://%41.example/", False), ("https://u^@h/", False),
])
def test_readable_addresses(spark, u, ok):
    assert one(spark, u, lambda c: urls.readable(c), "string") is ok


def test_an_address_that_cannot_be_read_breaks_its_event(spark):
    q = ["cid=a&tid=G&en=page_view&dl=https%3A%2F%2Fs.example%2F1", "cid=a&tid=G&en=click&dl=https%3A%2F%2Fs.example%2F%25zz", "cid=a&tid=G&en=click"]
    hits = pipeline.hits_from_requests(requests_of(spark, *q)).withColumn("property_id", F.lit("p"))
    rows = pipeline.build_events(hits, pipeline.Options(with_device=False)).orderBy("session_hit_number").collect()
    assert [(r["session_hit_number"], r["name"], r["session_total_events"]) for r in rows] == [(0, "page_view", 3), (2, "click", 3)]


def test_items_with_repeated_and_odd_codes(spark):
    text = "idA~nmShoe~id~pr2.5~prx~qt2~qt~k0note~v0x~brB~br~caC"
    df = spark.createDataFrame([("view", text), ("refund", "nm~pr1~pr3~qt4")], "name string, t string").withColumns({f"params_{n}": F.lit(None).cast("string") for n in ga4.ITEM_FALLBACKS})
    a, b = (r["i"] for r in df.select(ga4.item_struct(F.col("t")).alias("i")).collect())
    assert (a["item_id"], a["item_name"], a["price"], a["quantity"], a["item_revenue"], a["item_refund"], a["item_brand"], a["item_category"], a["coupon"]) == ("", "Shoe", 2.5, 2.0, 5.0, 0.0, "", "C", None)
    assert (b["item_name"], b["price"], b["quantity"], b["item_refund"], b["item_revenue"], b["item_id"]) == ("", 3.0, 4.0, 12.0, 0.0, None)


def test_parse_query(spark):
    assert one(spark, "a=1&b=x%20y&a=2&&c", urls.parse_query) == {"a": ["1", "2"], "b": ["x y"], "c": [""]}
    assert one(spark, None, urls.parse_query) == {}


def test_strip(spark):
    assert one(spark, "https://h/p?z=1&gclid=7&a=b c#f", urls.strip_params) == "https://h/p?a=b+c&z=1#f"
    assert one(spark, "https://h/p?z=1&a=2", urls.strip_params) == "https://h/p?z=1&a=2"
    assert one(spark, "https://h/p?gclid=7", urls.strip_params) == "https://h/p"


def test_addresses(spark):
    assert one(spark, "10.1.2.3", lambda c: addresses.mask_ip(c, 1)) == "10.1.2.0"
    assert one(spark, "10.1.2.3", lambda c: addresses.mask_ip(c, 4)) == "0.0.0.0"
    assert one(spark, "2001:db8:1:2::1", lambda c: addresses.mask_ip(c, 1)) == "2001:db8:1::"
    assert one(spark, "nonsense", lambda c: addresses.mask_ip(c, 2)) == "nonsense"
    assert one(spark, "256.1.1.1", addresses.ipv4_number) is None


def test_registry():
    col = lambda n, *d: ColumnDef(n, "string", lambda: F.lit(n), depends_on=d)
    assert [[c.name for c in layer] for layer in Registry([col("b", "a"), col("a"), col("c")]).layers()] == [["a", "c"], ["b"]]
    for bad in ([col("a"), col("a")], [col("a", "x")], [col("a", "a")], [col("a", "b"), col("b", "a")]):
        with pytest.raises(ValueError):
            Registry(bad)


def test_all_protocols_register():
    for p in ("ga4", "native", "matomo"):
        columns = pipeline.registry(pipeline.Options(protocol=p)).columns
        assert len(columns) >= 70
        assert {"page_location", "utm_source", "click_id_gclid", "ecommerce_items"} <= set(columns)


def test_schema_diff():
    a = StructType([StructField("x", LongType()), StructField("y", StringType()), StructField("z", DoubleType())])
    b = StructType([StructField("x", IntegerType()), StructField("z", FloatType())])
    missing, wrong = missing_columns(a, b)
    assert [f.name for f in missing] == ["y"] and {w.name for w in wrong} == {"x", "z"}
    assert not missing_columns(a, b, relaxed=True)[1]


RAW = "request_id string, server_received_time timestamp, query string, body string, host string, path string, method string, ip_address string, headers map<string,array<string>>, property_id string"


def raw(spark, query, body=""):
    return spark.createDataFrame([("r1", dt.datetime(2024, 1, 1), query, body, "h", "/g/collect", "POST", "1.2.3.4", {"User-Agent": ["curl"], "Accept-Language": ["de"]}, "p")], RAW)


def test_ga4_explode(spark):
    hits = pipeline.hits_from_requests(raw(spark, "cid=1&tid=G&en=x&dl=a", "en=page_view\n\nen=click&cid=2\n")).orderBy("name").collect()
    assert [(h["name"], h["client_id"]) for h in hits] == [("click", "2"), ("page_view", "1")]
    assert pipeline.hits_from_requests(raw(spark, "cid=1&en=x")).count() == 0  # no tid


def test_ga4_columns(spark):
    q = "cid=1&tid=G&en=purchase&dl=https%3A%2F%2Fs.example%2Fp%3Futm_source%3Dn%26k%3D1&ep.currency=EUR&epn.value=2.5&epn.bad=x&ep.b=2&pr1=idA~nmShoe~pr2.5~qt2&pr2=nmHat~pr1&gcs=G101&ir=1"
    r = pipeline.event_columns(pipeline.hits_from_requests(raw(spark, q)), pipeline.Options()).collect()[0]
    assert r["page_location"] == "https://s.example/p?k=1" and r["utm_source"] == "n" and r["page_path"] == "/p"
    assert r["params_value"] == 2.5 and r["params_currency"] == "EUR" and r["params_coupon"] is None
    assert [(p["name"], p["value_string"], p["value_number"]) for p in r["params"]] == [("b", "2", None), ("currency", "EUR", None), ("value", None, 2.5)]
    assert [i["item_name"] for i in r["ecommerce_items"]] == ["Shoe", "Hat"]
    # An item without a quantity has 0 of it.
    assert r["ecommerce_purchase_revenue"] == 5.0 and r["ecommerce_unique_items"] == 1 and r["ecommerce_items_total_quantity"] == 2
    assert r["privacy_analytics_storage"] is False or r["privacy_analytics_storage"] is True
    assert r["ignore_referrer"] is True and r["device_language"] == "de" and r["tracking_protocol"] == "ga4_gtag"


def test_matomo(spark):
    body = '{"requests": ["?idsite=1&_id=a&url=https%3A%2F%2Fm.example%2F&action_name=T&dimension2=x&dimension10=y&cvar=%7B%221%22%3A%5B%22k%22%2C%22v%22%5D%7D", "?idsite=1&cid=b&search=shoes", "?idsite=1&_id=a&idgoal=0&ec_id=9&ec_items=%5B%5B%22s%22%2C%22n%22%2C%5B%22c1%22%2C%22c2%22%5D%2C2.5%2C3%5D%5D&revenue=7.5"]}'
    hits = pipeline.hits_from_requests(raw(spark, "", body), "matomo")
    rows = {r["name"]: r for r in pipeline.event_columns(hits, pipeline.Options(protocol="matomo")).collect()}
    assert set(rows) == {"page_view", "site_search", "ecommerce_order"}
    assert [tuple(d) for d in rows["page_view"]["custom_dimensions"]] == [(2, "x"), (10, "y")]
    assert [tuple(d) for d in rows["page_view"]["custom_variables"]] == [("k", "v")]
    item = rows["ecommerce_order"]["ecommerce_items"][0]
    assert (item["item_id"], item["item_category"], item["item_category2"], item["price"], item["quantity"]) == ("s", "c1", "c2", 2.5, 3.0)
    assert rows["ecommerce_order"]["ecommerce_items_total_quantity"] == 3
    wide = pipeline.build_events(hits.withColumn("property_id", F.lit("p")), pipeline.Options(protocol="matomo")).collect()
    assert len(wide) == 3 and "session_custom_dimensions" in wide[0].asDict()


def test_custom_columns():
    with pytest.raises(ValueError):
        ga4.custom_param("x", "y", "boolean")
    assert matomo.custom_dimension("d", 2).depends_on == ("custom_dimensions",)


def test_validation(spark):
    hits = pipeline.hits_from_requests(raw(spark, "cid=1&tid=G&en=x&dl=a"))
    good, bad = requests.validate(hits)
    assert (good.count(), bad.count()) == (1, 0)
    good, bad = requests.validate(hits.withColumn("host", F.lit("")), max_bytes=5)
    assert bad.collect()[0]["errors"] == ["host", "size"]


def test_rates_and_devices(spark):
    snaps = spark.createDataFrame([(dt.datetime(2024, 1, 1), {"EUR": {"USD": 1.0}}), (dt.datetime(2024, 1, 2), {"EUR": {"USD": 1.125}})], "created_at timestamp, rates map<string,map<string,double>>")
    got = lookups.convert(spark.createDataFrame([(1.0, "eur"), (None, "eur"), (3.333, "USD")], "v double, c string"), lookups.latest_rates(snaps), "v", "c", "usd", "o").collect()
    assert [r["o"] for r in got] == [1.12, None, 3.333]
    d = lookups.parse_agent("Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1")
    assert (d["device_category"], d["device_operating_system"], d["device_operating_system_version"], d["device_web_browser"]) == ("smartphone", "iOS", "17.1", "Mobile Safari")
    assert lookups.parse_agent("Googlebot/2.1")["device_category"] == "bot" and lookups.parse_agent(None)["device_category"] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], True), ("b", None, None)], "id string, xs array<int>, ok boolean")
    sinks.write_parquet(df, str(tmp_path / "p"), partitioned=True)
    assert spark.read.parquet(str(tmp_path / "p")).select("id", "xs").count() == 2
    sinks.write_csv(df, str(tmp_path / "c"), gzip=True)
    assert sorted(r["xs"] or "" for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["", "[1,2]"]
    assert sinks.escape_name("a b/c") == "a_b_c" and sinks.quote("a`b") == "`a``b`" and len(sinks.fingerprint(df.schema)) == 16


def test_stream(spark, tmp_path):
    from hitloom.streaming import sessions

    schema = "property_id string, client_id string, id string, name string, page_location string, ts timestamp"
    t = dt.datetime(2024, 1, 1)
    rows = [("p", "a", "1", "page_view", "/x", t), ("p", "a", "2", "click", "/x", t + dt.timedelta(minutes=10)), ("p", "b", "3", "page_view", "/y", t)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    later = [("p", "z", "9", "page_view", "/z", t + dt.timedelta(hours=5))]
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.stream_sessions(src).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["client_id"], r["id"], r["session_hit_number"], r["session_total_events"], r["session_duration"]) for r in spark.table("closed").collect()}
    assert got == {("a", "1", 0, 2, 600), ("a", "2", 1, 2, 600), ("b", "3", 0, 1, 0)}
    late = [*rows, ("p", "a", "7", "click", "/x", t + dt.timedelta(minutes=1))]
    keep = schema + ", value double, tags map<string,array<string>>"
    for i, some in enumerate((late[:3], later, late[3:], [("p", "y", "10", "page_view", "/z", t + dt.timedelta(hours=9))])):
        spark.createDataFrame([(*r, 1.5, {"k": ["v"]}) for r in some], keep).coalesce(1).write.parquet(str(tmp_path / f"in2/{i}"))
    src = spark.readStream.schema(keep).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in2"))
    q = sessions.stream_sessions(src).writeStream.format("memory").queryName("more").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["id"]: (r["is_late"], r["value"], r["tags"]) for r in spark.table("more").collect()}
    assert got["1"] == (False, 1.5, {"k": ["v"]}) and got["7"][0] is True and got["7"][1] == 1.5 and got["9"][0] is False


def requests_of(spark, *queries, headers=None):
    rows = [(f"r{i}", q, "", dt.datetime(2024, 1, 1, 0, i)) for i, q in enumerate(queries)]
    df = spark.createDataFrame(rows, "request_id string, query string, body string, server_received_time timestamp")
    heads = F.create_map(*[x for k, v in (headers or {"User-Agent": "x"}).items() for x in (F.lit(k), F.array(F.lit(v)))])
    return df.select("*", F.lit("h").alias("host"), F.lit("/").alias("path"), F.lit("GET").alias("method"), F.lit("10.1.2.3").alias("ip_address"), heads.alias("headers"))


def test_intake_with_properties_masks_and_rejects(spark):
    settings = spark.createDataFrame([("G-1", "p1", "Shop", "ga4"), ("G-2", "p2", "Blog", "matomo")], "measurement_id string, property_id string, property_name string, property_protocol string")
    raw_rows = requests_of(spark, "cid=a&tid=G-1&en=page_view&dl=https%3A%2F%2Fs.example%2F", "cid=a&tid=G-2&en=x", "cid=b&tid=G-9&en=x", "cid=&tid=G-1&en=", headers={"X-Real-IP": "192.0.2.77"})
    judged = pipeline.hits_from_requests(raw_rows, "ga4", settings, mask_level=1, trusted_proxy=True, max_bytes=10_000)
    bad = {r["request_id"]: set(r["errors"]) for r in pipeline.rejects(judged).collect()}
    assert bad == {"r1": {"protocol"}, "r2": {"property_id", "protocol"}, "r3": {"client_id", "name"}}
    good = pipeline.accepted(judged)
    wide = pipeline.build_events(good, pipeline.Options(isolate=True)).collect()
    assert [(r["property_id"], r["property_name"], r["ip_address"], r["client_id"]) for r in wide] == [("p1", "Shop", "192.0.2.0", "a")]


def test_broken_sessions_and_session_columns(spark):
    q = ["cid=a&tid=G&en=page_view&dl=https%3A%2F%2Fs.example%2F1&ep.plan=x&seg=1", "cid=a&tid=G&en=click&dl=https%3A%2F%2Fs.example%2F1&ep.plan=y", "cid=a&tid=G&en=click", "cid=b&tid=G&en=click&dl=d"]
    hits = pipeline.hits_from_requests(requests_of(spark, *q)).withColumn("property_id", F.lit("p"))
    plan = [{"name": "plan", "parameter": "plan"}, {"name": "session_plan", "scope": "session", "parameter": "plan"}]
    custom = [*columns.custom_columns(plan, ga4.custom_param), shared_columns.session_param("last_event_plan", "ep.plan"), columns.ColumnDef("needed", "string", lambda: F.when(F.col("client_id") == "a", "x"), breaks=True)]
    rows = pipeline.build_events(hits, pipeline.Options(custom=custom, join_by_user=True)).orderBy("ts").collect()
    assert [(r["client_id"], r["plan"], r["session_plan"], r["last_event_plan"], r["session_is_engaged"]) for r in rows] == [("a", "x", "y", None, True), ("a", "y", "y", None, True), ("a", None, "y", None, True)]
    # An address that can't be read breaks the whole session.
    broken = columns.ColumnDef("page_location", "string", lambda: F.when(F.col("id") != hits.orderBy("ts").first()["id"], "x"))
    own = dataclasses.replace(pipeline.PROTOCOLS["ga4"], columns=lambda rates, excluded: [broken if c.name == "page_location" else c for c in ga4.columns()])
    assert {r["client_id"] for r in pipeline.build_events(hits, pipeline.Options(protocol=own)).collect()} == {"b"}


def test_sinks_layout_and_order(spark):
    df = spark.createDataFrame([(1, "a")], "b int, a string")
    assert sinks.in_table_order(df, ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.in_table_order(df, ["a"])
    path = sinks.table_path("{table}/y={year}/m={month}/d={day}/{segment}{extension}", "e v", df.schema, dt.datetime(2024, 5, 6), "s1", ".parquet")
    assert path == "e_v/y=2024/m=05/d=06/s1.parquet" and sinks.segment_rows(df, 1000) > 10


def test_referrer_lists_from_files(spark, tmp_path):
    (tmp_path / "search.yaml").write_text("Foo:\n  -\n    urls:\n      - 'foo.{}'\n      - '{}.foo.example'\n    params:\n      - '/x/'\n      - q\n")
    (tmp_path / "social.yaml").write_text("Bar:\n  - bar.example\n")
    table = attribution.read_referrers(spark, {"search": str(tmp_path / "search.yaml"), "social": str(tmp_path / "social.yaml")})
    first = spark.createDataFrame([("https://www.foo.co.uk/s?q=Red+Shoe",), ("https://m.bar.example/x",), ("https://a.foo.example/?q=",), ("",)], "page_referrer string").withColumns({"original_page_location": F.lit("https://s.example/"), "ignore_referrer": F.lit(False)})
    got = [tuple(r)[-3:] for r in attribution.attribute(first, table).collect()]
    assert got == [("foo", "organic", "red-shoe"), ("bar", "social", None), ("foo", "organic", None), ("direct", "none", None)]


def test_matomo_categories_are_made_once_an_item():
    from hitloom.sources import matomo

    assert "array<variant>" not in matomo._item_sql() and matomo._categories_sql().count("array<variant>") == 1


def test_items_are_chosen_and_their_currency_told_before_they_are_parsed(spark):
    """An item without id and name isn't parsed; whether amounts are dollars is told once an event, not in the items' lambda."""
    items = next(c for c in ga4.columns(with_rates=True) if c.name == "ecommerce_items")
    assert "_in_usd" in items.depends_on and "params_currency" not in items.depends_on
    df = spark.sql("select map('pr2', array('brX~pr3'), 'pr1', array('idA~pr2.5~qt2~prx', 'nmB~qt3~pr1e1')) query_params, 'refund' name, 2.0D _usd_rate, false _in_usd")
    df = df.selectExpr("*", *[f"cast(null as string) params_{n}" for n in ga4.ITEM_FALLBACKS]).select(items.build().alias("i"))
    got = [(x["item_id"], x["item_name"], x["price"], x["quantity"], x["item_refund"], x["item_revenue"], x["price_in_usd"], x["item_refund_in_usd"]) for x in df.first()["i"]]
    assert got == [("A", None, 2.5, 2.0, 5.0, 0.0, 5.0, 10.0), (None, "B", 10.0, 3.0, 30.0, 0.0, 20.0, 60.0)]


def test_parse_query_of_malformed_and_repeated_pairs(spark):
    got = one(spark, "a=%zz&b=1=2&%61=x+y&c;d=1&=e&a=+&f", urls.parse_query)
    assert got == {"b": ["1=2"], "a": ["x y", " "], "": ["e"], "f": [""]}
