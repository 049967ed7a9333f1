"""Sessionization, splitting, identity and page flow against hand-written models."""

import datetime as dt
import random

import pandas as pd
import pytest
from hitloom.operators import filters, page_flow, session_totals, sessionize
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1, 12)


def hits(spark, rows):
    """rows: (offset seconds, client, stamp, user)"""
    data = [(f"h{i:03d}", "p", c, s, u, T0 + dt.timedelta(seconds=o)) for i, (o, c, s, u) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, property_id string, client_id string, session_stamp string, user_id string, ts timestamp")


def owners(df):
    return [r["stitched_client_id"] for r in df.orderBy("id").collect()]


def test_gap_is_kept_at_the_time_out(spark):
    rows = sessionize.sessionize(hits(spark, [(0, "a", None, None), (1800, "a", None, None), (3601, "a", None, None)])).orderBy("id").collect()
    assert [r["proto_seq"] for r in rows] == [0, 0, 1]


def test_a_hot_client_is_shared_by_ranges_of_time(spark):
    rng = random.Random(12)
    rows = [(rng.randrange(400_000), "hot", None, None) for _ in range(1500)] + [(rng.randrange(400_000), f"c{i % 40}", None, None) for i in range(1500)]
    rows += [(rng.randrange(20) * 1800, None, None, None) for _ in range(200)] + [(7, "hot", None, None)] * 40
    df = hits(spark, rows)
    seq = lambda d: {r["id"]: r["proto_seq"] for r in d.collect()}
    shared = sessionize.sessionize(df, 600, hot_hits=100)
    assert shared.columns == [*df.columns, "proto_seq"] and seq(shared) == seq(sessionize.sessionize(df, 600, hot_hits=None)) and max(seq(shared).values()) > 100
    cuts = sessionize.hot_clients(df, sessionize.CLIENT, hot_hits=100)
    assert {r["_h1"] for r in cuts.collect()} == {"hot", None} and sessionize.hot_clients(df, sessionize.CLIENT, hot_hits=5000) is None
    # Half of all hits spread over at least 32 tasks.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        spread = sessionize.sessionize(df, 600, hot_hits=100).where("client_id = 'hot'").withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("proto_seq").alias("count"), F.max("proto_seq")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(spread) >= 32 and max(r["count"] for r in spread) < 200


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(0, "a", None, None)], ["a"]),
        ([(0, "a", None, None), (1, "b", None, None)], ["a", "b"]),
        ([(0, "a", "s", None), (1, "b", "s", None)], ["a", "a"]),
        ([(0, "a", None, "u"), (1, "b", None, "u")], ["a", "a"]),
        ([(0, "a", "s", None), (1, "b", "s", "u"), (2, "c", None, "u")], ["a", "a", "b"]),  # chains aren't followed
        ([(0, "a", "s", None), (4000, "b", "s", None)], ["a", "b"]),  # the key is free again
        ([(0, "a", "s", None), (1700, "a", None, None), (3400, "b", "s", None)], ["a", "a", "a"]),
        ([(0, "a", "s", None), (4000, "a", None, None), (4001, "b", "s", None)], ["a", "a", "b"]),  # a new session of the owner doesn't bring it back
    ],
)
def test_stitching(spark, rows, want):
    assert owners(sessionize.stitch(hits(spark, rows))) == want


def test_stitching_with_little_state(spark, monkeypatch):
    rng = random.Random(8)
    rows = sorted((rng.randrange(40_000), rng.choice("abcdefgh"), rng.choice(["s", "t", "x", None]), rng.choice(["u", "v", None])) for _ in range(200))
    batch = tuple(pd.Series(list(c), dtype=object) for c in zip(*[("g", t * 1_000_000, c, s, u) for t, c, s, u in rows]))
    run = lambda: next(sessionize._owners(iter([batch]), 1800, True, True)).tolist()
    want = run()
    monkeypatch.setattr(sessionize, "STITCH_STATE", 2)
    assert run() == want and want == owners(sessionize.stitch(hits(spark, rows)))


def test_stitching_in_groups_equals_the_fold_over_a_property(spark):
    rng = random.Random(19)
    rows = sorted((rng.randrange(400_000), rng.choice([f"c{i}" for i in range(40)]), rng.choice([f"s{i}" for i in range(60)] + [None] * 60), rng.choice([f"u{i}" for i in range(20)] + [None] * 80)) for _ in range(600))
    rows = [(t * 1.0, *r) for t, *r in rows]
    batch = tuple(pd.Series(list(c), dtype=object) for c in zip(*[("g", int(t * 1_000_000), c, s, u) for t, c, s, u in rows]))
    want = next(sessionize._owners(iter([batch]), 1800, True, True)).tolist()
    df = hits(spark, rows)
    assert owners(sessionize.stitch(df)) == owners(sessionize.stitch(df, fold_rows=100)) == want and any(w != r[1] for w, r in zip(want, rows))
    grouped = sessionize.stitching_groups(df.withColumnsRenamed({"session_stamp": "_stamp", "user_id": "_user"}), 1800, True, True, fold_rows=100)
    n = [r["n"] for r in grouped.where("_group is not null").groupBy("_group").agg(F.count("*").alias("n")).collect()]
    assert len(n) > 20 and max(n) < 300  # one property, many groups


def test_groups_that_no_round_cuts_are_tried_once_and_hits_stay_in_place(spark, monkeypatch):
    rng = random.Random(23)
    rows = sorted((rng.randrange(20_000), f"c{rng.randrange(30)}", rng.choice(["s", "t", None]), rng.choice(["u", None])) for _ in range(500))
    df = hits(spark, [(float(t), *r) for t, *r in rows])
    tries, found = [], sessionize.components
    monkeypatch.setattr(sessionize, "components", lambda edges: tries.append(edges.count()) or found(edges))
    grouped = sessionize.stitching_groups(df.withColumnsRenamed({"session_stamp": "_stamp", "user_id": "_user"}), 1800, True, True, fold_rows=100)
    assert len(tries) == 1 and tries[0] <= 3  # edges between keys alone, not of 30 clients
    assert "hashpartitioning" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert grouped.where("_group is not null").select("_group").distinct().count() == 1
    want = owners(sessionize.stitch(df))
    assert owners(sessionize.stitch(df, fold_rows=100)) == want
    monkeypatch.setattr(sessionize, "small", lambda t: t)  # too many clients and pieces to be broadcast
    assert owners(sessionize.stitch(df, fold_rows=100)) == want


def test_stamp_runs_agree_with_the_fold(spark):
    rng = random.Random(3)
    rows = sorted((rng.randrange(20_000), rng.choice("abc"), rng.choice(["s", "t", None]), None) for _ in range(40))
    df = hits(spark, [r for r in rows if r[2]])
    got = sessionize.stitch_by_stamp(df, 1_000_000)
    assert owners(got) == owners(sessionize.stitch(df, 1_000_000, by_user=False))


def model_split(rows, max_s, max_events):
    out, first, n, user, camp, idx = [], None, 0, None, None, 0
    for t, u, c in rows:
        cause = None
        if first is not None:
            if t - first >= max_s:
                cause = sessionize.SPLIT_CAUSES[0]
            elif n >= max_events:
                cause = sessionize.SPLIT_CAUSES[1]
            elif u and user and u != user:
                cause = sessionize.SPLIT_CAUSES[2]
            elif c is not None and camp is not None and c != camp:
                cause = sessionize.SPLIT_CAUSES[3]
        if first is None or cause:
            first, n, user, camp, idx = t, 0, None, None, idx + bool(cause)
        n, user, camp = n + 1, u or user, c if c is not None else camp
        out.append((idx, cause))
    return out


def test_split_against_model(spark):
    rng = random.Random(5)
    data, want = [], {}
    for s in range(30):
        rows = sorted([(rng.randrange(500), rng.choice([None, "", "u", "v"]), rng.choice([None, "x", "y"])) for _ in range(rng.randrange(1, 25))], key=lambda r: r[0])
        for i, ((t, u, c), w) in enumerate(zip(rows, model_split(rows, 200, 6))):
            data.append((f"{s:02d}-{i:03d}", "p", f"c{s}", 0, u, c, T0 + dt.timedelta(seconds=t)))
            want[data[-1][0]] = w
    df = spark.createDataFrame(data, "id string, property_id string, client_id string, proto_seq long, user_id string, utm_campaign string, ts timestamp")
    # Equal times are ordered by id, as the rows were made.
    got = {r["id"]: (r["split_idx"], r["_split_cause"]) for r in sessionize.split(df, 200, 6).collect()}
    assert got == want


def events(spark, rows):
    data = [(f"e{i:02d}", "p", "c", 0, 0, n, loc, title, T0 + dt.timedelta(seconds=o)) for i, (n, o, loc, title) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, property_id string, client_id string, proto_seq long, split_idx long, name string, page_location string, page_title string, ts timestamp")


def test_page_flow_keeps_null_titles(spark):
    rows = [("scroll", 0, "/a", "A"), ("page_view", 5, "/a", "A"), ("page_view", 15, "/b", None), ("click", 16, "/b", None), ("page_view", 40, "/c", "C")]
    got = page_flow.add_page_flow(events(spark, rows)).orderBy("id").collect()
    assert [r["previous_page_title"] for r in got] == [None, None, "A", "A", None]
    assert [r["next_page_title"] for r in got] == ["A", None, "C", "C", None]
    assert [r["previous_page_location"] for r in got] == [None, None, "/a", "/a", "/b"]
    assert [r["time_on_page"] for r in got] == [5, 10, 25, 25, 0]
    assert [r["session_is_entry_page"] for r in got] == [False, True, False, False, False]
    assert [r["session_is_exit_page"] for r in got] == [False, False, False, False, True]


def test_no_page_view(spark):
    got = page_flow.add_page_flow(events(spark, [("click", 0, "/a", "A"), ("click", 9, "/a", "A")])).collect()
    assert all(not r["session_is_entry_page"] and not r["page_is_bounce"] and r["next_page_location"] is None for r in got)
    assert [r["time_on_page"] for r in got] == [9, 9]


def test_windows_equal_aggregation(spark):
    rows = [("page_view", i * 7, f"/{i % 3}", "T" if i % 4 else None) for i in range(12)]
    df = events(spark, rows)
    one = session_totals.session_rows(df).collect()[0].asDict()
    for r in session_totals.on_every_event(df).collect():
        assert all(r[k] == v for k, v in one.items())


def test_filters(spark):
    df = spark.createDataFrame([("1", "10.1.2.3", "a"), ("2", "8.8.8.8", None), ("3", "2001:db8::1", "b")], "id string, ip string, v string")
    run = lambda *c: [r["id"] for r in filters.apply_filters(df, list(c), ["id", "ip", "v", "missing"]).orderBy("id").collect()]
    assert run(filters.Condition("x", "exclude", "in_cidr(ip, '10.0.0.0/8') or in_cidr(ip, '2001:db8::/32')")) == ["2"]
    assert run(filters.Condition("x", "allow", "v = '<nil>' or missing = 'y'")) == ["2"]
    assert run(filters.Condition("x", "exclude", "v = 'a'"), filters.Condition("y", "allow", "true")) == ["2", "3"]
    # What fails on an event, or is neither true nor false, is skipped for it.
    assert run(filters.Condition("x", "exclude", "v > 5")) == run(filters.Condition("x", "exclude", "1 / (id - 2) > 0 and v > 5")) == run(filters.Condition("x", "exclude", "v")) == ["1", "2", "3"]
    assert run(filters.Condition("x", "exclude", "id >= 2")) == ["1"] and run(filters.Condition("x", "exclude", "v = 'it''s'")) == ["1", "2", "3"]
    assert [r["id"] for r in filters.apply_filters(df, [filters.Condition("x", "allow", "is_local(ip)")], ["ip"], {"is_local": ("ip string", "boolean", "startswith(ip, '10.')")}).collect()] == ["1"]
    with pytest.raises(Exception):
        run(filters.Condition("x", "exclude", "v == == 'a'"))


def test_filters_with_numbers_and_patterns(spark):
    df = spark.createDataFrame([("1", "60.5", "a 60"), ("2", "60", "b"), ("3", "7", "60"), ("4", "x", None)], "id string, v string, t string")
    run = lambda text, kind="exclude": [r["id"] for r in filters.apply_filters(df, [filters.Condition("x", kind, text)], ["id", "v", "t"]).orderBy("id").collect()]
    assert run("v > 60") == ["2", "3", "4"] and run("60 < v") == ["2", "3", "4"] and run("v >= 60") == ["3", "4"] and run("v > 6.9 and v < 8") == ["1", "2", "4"]
    assert run("v = 60") == ["1", "3", "4"] and run("v = 60.5") == ["2", "3", "4"] and run("v in (60, 7)") == ["1", "4"] and run("v between 60 and 61") == ["3", "4"]
    assert run("t = '60'") == run("t = 60") == ["1", "2", "4"] and run("t = 'a 60'") == ["2", "3", "4"]  # numbers in text stay text
    assert run("substring(t, 1, 1) = 'a'") == ["2", "3", "4"] and run("split(t, ' ')[1] = '60'") == ["2", "3", "4"] and run("`v` % 2 = 0", "allow") == ["2"]
    assert run("length(v) = 4 and t rlike '^a [0-9]{2}$'") == ["2", "3", "4"]
    for bad in ("t rlike '('", "v = 'nothing' and t rlike '[a'", "regexp_replace(t, '*', '') = ''", "not (v = 'x' or regexp_count(t, '(?<') > 0)"):
        with pytest.raises(ValueError):
            filters.apply_filters(df, [filters.Condition("x", "exclude", bad)], ["v", "t"])


def test_clients_are_counted_without_parsing_the_hits(spark, monkeypatch):
    from hitloom.plans import catalogue, pipeline

    counted, found = [], sessionize.hot_clients
    monkeypatch.setattr(sessionize, "hot_clients", lambda *a, **k: counted.append(a) or found(*a, **k))
    catalogue.QUERIES["wide_sessions"](spark, "/root/testdata/sf0.001")
    assert not counted
    raw = spark.createDataFrame([("v=2&cid=a", ""), ("cid=%61", "en=x&cid=b\n\nen=y\n"), ("en=z", "")], "query string, body string")
    assert sorted(r["client_id"] for r in pipeline.clients_of(raw).collect()) == ["", "a", "a", "b"]
    df = hits(spark, [(0, "a", None, None), (5000, "a", None, None), (1, "b", None, None)])
    some = spark.createDataFrame([("a",), ("a",)], "client_id string")
    for hot, times in ((1, 1), (2, 1)):  # hot for the cheap count: the hits are counted; else they aren't
        out = sessionize.sessionize(df, hot_hits=hot, clients=some)
        assert len(counted) == times and {r["id"]: r["proto_seq"] for r in out.collect()} == {"h000": 0, "h001": 1, "h002": 0}
