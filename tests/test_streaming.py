"""Streams against the batch plans of the same hits."""

import datetime as dt
import random

import numpy as np
from hitloom.operators import sessionize
from hitloom.streaming import sessions
from pyspark.sql import Window
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
HITS = "property_id string, client_id string, id string, name string, page_location string, ts timestamp, session_stamp string, user_id string, utm_campaign string, n long"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(spark, tmp_path, batches, name, **options):
    """Rows of the stream, and for each micro-batch the ids that came out and the rows of state after it."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, HITS).coalesce(1).write.parquet(str(tmp_path / f"{name}/{i:03d}"))
    source = spark.readStream.schema(HITS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
    got, seen = [], []

    def collect(batch, _):
        rows = batch.collect()
        got.extend(rows)
        seen.append([r["id"] for r in rows])

    q = sessions.stream_sessions(source, grace_s=0, **options).writeStream.foreachBatch(collect).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return got, seen, [sum(s.numRowsTotal for s in p.stateOperators) for p in q.recentProgress]


def beat(seconds):
    return [("p", "clock", None, None, None, at(seconds), None, None, None, 0)]


def test_cuts_against_the_fold():
    rng = random.Random(2)
    limits = sessions.Limits(200, 6)
    for _ in range(60):
        rows = sorted(((rng.randrange(3000) * 1_000_000, rng.choice([None, None, "u", "v"]), rng.choice([None, None, "x", "y"])) for _ in range(rng.randrange(1, 40))), key=lambda r: r[0])
        times, users, campaigns = np.array([r[0] for r in rows]), [r[1] for r in rows], [r[2] for r in rows]
        got = [(seq, index, cause if i == start else None) for start, end, seq, index, cause in sessions.parts_of(times, users, campaigns, 100, limits, None) for i in range(start, end)]
        seqs = np.r_[0, np.cumsum(np.diff(times) > 100_000_000)].tolist()
        import pandas as pd

        cut = next(sessionize._cuts(iter([(pd.Series([str(s) for s in seqs]), pd.Series(times), pd.Series(users, dtype=object), pd.Series(campaigns, dtype=object))]), 200, 6, True, True))
        assert got == [(s, i, c) for s, i, c in zip(seqs, cut["split_idx"].tolist(), cut["cause"].tolist())]


def test_busy_client_leaves_in_parts_and_equals_the_batch_plan(spark, tmp_path):
    rng, rows, number = random.Random(7), [], 0
    for batch in range(9):
        some = []
        for _ in range(14):  # never rests for a time-out
            number += 1
            some.append(("p", "busy", f"h{number:04d}", "page_view", "/x", at(batch * 1400 + rng.randrange(1400)), None, rng.choice([None, "u1", "u2"]) if batch == 4 else "u1", rng.choice([None, "c"]), number))
        for client in "abc":
            if rng.random() < 0.4:
                number += 1
                some.append(("p", client, f"h{number:04d}", "click", "/y", at(batch * 1400 + rng.randrange(1400)), None, None, None, number))
        rows.append(some)
    limits = sessions.Limits(5000, 20)
    got, seen, state = run(spark, tmp_path, [*rows, beat(40_000), beat(50_000), beat(60_000)], "busy", timeout_s=1800, limits=limits)
    hits = spark.createDataFrame([r for some in rows for r in some], HITS)
    plan = sessionize.split(sessionize.sessionize(hits, 1800), limits.max_s, limits.max_events)
    part = Window.partitionBy("property_id", "client_id", "proto_seq", "split_idx")
    order = part.orderBy("ts", "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = plan.select(
        "client_id", "id", "n", "user_id", "utm_campaign", "split_idx", F.first("_split_cause").over(whole).alias("cause"), F.first("id").over(whole).alias("session_id"), (F.row_number().over(order) - 1).alias("hit"),
        F.count("*").over(part).alias("total"), (F.unix_seconds(F.max("ts").over(part)) - F.unix_seconds(F.min("ts").over(part))).alias("duration"),
    ).collect()
    assert not any(r["is_late"] for r in got)
    mine = {r["id"]: (r["client_id"], r["n"], r["user_id"], r["utm_campaign"], r["split_idx"], r["session_split_cause"], r["session_id"], r["session_hit_number"], r["session_total_events"], r["session_duration"]) for r in got}
    want_rows = {r["id"]: (r["client_id"], r["n"], r["user_id"], r["utm_campaign"], r["split_idx"], r["cause"], r["session_id"], r["hit"], r["total"], r["duration"]) for r in want}
    assert [(mine.get(i), w) for i, w in want_rows.items() if mine.get(i) != w] == [] and len(mine) == len(want_rows)
    busy = {r["id"] for r in got if r["client_id"] == "busy"}
    assert sum(bool(set(s) & busy) for s in seen[: len(rows)]) >= 4 and max(r["split_idx"] for r in got) >= 5  # while it is busy
    assert max(state) < 0.6 * number and state[-1] < 12  # only what is open is held, and idle clients are forgotten


def test_stitching_in_a_stream_equals_the_batch_rule(spark, tmp_path):
    rng, rows, number = random.Random(2), [], 0
    for batch in range(6):
        times = sorted(rng.randrange(1500) for _ in range(25))
        some = []
        for t in times:
            number += 1
            client = rng.choice([f"c{i}" for i in range(8)])
            some.append((rng.choice("pq"), client, f"h{number:04d}", "click", "/", at(batch * 1500 + t), rng.choice([None, "", *[f"s{i}" for i in range(6)]]), rng.choice([None, None, "", "u1", "u2", "u3"]), None, number))
        rows.append(some)
    fixed = [(0, "a", "s", None), (1700, "a", None, None), (3400, "b", "s", None), (3500, "x", "t", None), (3501, "y", "t", "u"), (3502, "z", None, "u"), (8000, "y", "t", None)]
    for k, (t, client, stamp, user) in enumerate(fixed):
        rows[min(t // 1500, 5)].append(("scene", client, f"z{k}", "click", "/", at(t), stamp, user, None, 0))
    got, _, state = run(spark, tmp_path, [*rows, beat(40_000), beat(50_000), beat(60_000)], "stitch", timeout_s=1800, join_by_stamp=True, join_by_user=True)
    hits = spark.createDataFrame([r for some in rows for r in some], HITS)
    want = {r["id"]: r["stitched_client_id"] for r in sessionize.stitch(hits).collect()}
    assert {r["id"]: r["client_id"] for r in got} == want and all(r["n"] == int(r["id"][1:]) or r["id"][0] == "z" for r in got)
    own = {r[2]: r[1] for some in rows for r in some}
    assert {r["id"]: r["own_client_id"] for r in got} == own and sum(want[i] != own[i] for i in own) > 10
    assert [want[f"z{k}"] for k in range(7)] == ["a", "a", "a", "x", "x", "y", "y"]
    assert state[-1] <= 12 < max(state)


def test_closed_parts_become_wide_rows(spark, tmp_path):
    from hitloom.plans import pipeline

    rows = [("p", "a", f"h{i:02d}", "page_view", "/x", at(i * 600), None, None, None, i) for i in range(12)]
    out = {"wide": [], "late": []}
    keep = lambda kind: lambda df, number: out[kind].extend(df.collect())
    options = pipeline.Options(with_device=False)
    write = sessions.write_wide(options, keep("wide"), keep("late"))
    for i, some in enumerate([rows[:6], rows[6:], beat(40_000), beat(50_000)]):
        spark.createDataFrame(some, HITS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    source = spark.readStream.schema(HITS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    source = source.drop("page_location").withColumns({"page_location": F.lit("/x"), "ip_address": F.lit("10.0.0.1"), "headers": empty, "query_params": F.create_map(F.lit("dl"), F.array(F.lit("https://s.example/x")))})
    stream = sessions.stream_sessions(source, grace_s=0, limits=sessions.Limits(max_events=5)).drop("page_location")
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert [(r["id"], r["session_id"], r["session_total_events"], r["session_split_cause"]) for r in sorted(out["wide"], key=lambda r: r["id"])] == [
        (f"h{i:02d}", f"h{i // 5 * 5:02d}", 5 if i < 10 else 2, None if i < 5 else "max_events_reached") for i in range(12)
    ]


class _State:
    """A list or value state, and the handle and times of one key, in memory; counts the updates."""

    def __init__(self):
        self.held, self.updates = None, 0

    def __getattr__(self, name):
        kept = lambda v=None: (setattr(self, "held", v), setattr(self, "updates", self.updates + 1))
        return {"exists": lambda: self.held is not None, "get": lambda: self.held or (), "update": kept, "clear": lambda: setattr(self, "held", None), "appendList": lambda v: kept([*(self.held or []), *v])}[name]


def test_parts_that_close_together_leave_in_one_frame():
    from types import SimpleNamespace

    import pandas as pd
    from hitloom.streaming import sessions

    made = {}
    state = lambda name, _: made.setdefault(name, _State())
    p = sessions.SessionProcessor(1800, 88_200, sessions.Limits(10**9, 3))
    p.init(SimpleNamespace(getListState=state, getValueState=state, registerTimer=lambda at: None, deleteTimer=lambda at: None))
    seconds = [i * 60 + (i // 50) * 7200 for i in range(1000)]
    hits = pd.DataFrame({"id": [f"{i:04}" for i in range(1000)], "name": "n", "page_location": None, "ts": pd.to_datetime(seconds, unit="s"), "user_id": None, "utm_campaign": None, "payload": None})
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    assert not list(p.handleInputRows(("p", "c"), iter([hits]), now))
    late = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9)
    frames = list(p.handleExpiredTimer(("p", "c"), late, None))
    assert len(frames) == 1 and made["left"].updates == 1 and list(frames[0].columns) == sessions._COLUMNS
    want = [(f"{i:04}", f"{i - i % 50 % 3:04}", i // 50, i % 50 // 3, i % 50 % 3, 2 if i % 50 > 47 else 3) for i in range(1000)]
    got = frames[0][["id", "session_id", "proto_seq", "split_idx", "session_hit_number", "session_total_events"]]
    assert list(got.itertuples(index=False, name=None)) == want
    assert frames[0]["session_split_cause"].notna().tolist() == [i % 50 >= 3 for i in range(1000)]


class _Values(_State):
    """As a list state, also one value at a time."""

    def __getattr__(self, name):
        if name == "appendValue":
            return lambda v: setattr(self, "held", [*(self.held or []), v])
        return super().__getattr__(name)


def _called(processor, key, states):
    """A processor of one key with its states and timers in memory: a function of a batch and the clock, that gives the frames."""
    from types import SimpleNamespace

    timers = set()
    state = lambda name, _: states.setdefault((key, name), _Values())
    processor.init(SimpleNamespace(getListState=state, getValueState=state, registerTimer=timers.add, deleteTimer=timers.discard))

    def call(rows, clock_s):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: clock_s * 1000 - processor.behind_ms if clock_s else 0)
        out = list(processor.handleInputRows(key, iter([rows]), now)) if len(rows) else []
        for due in sorted(t for t in timers if clock_s and t <= now.getCurrentWatermarkInMs()):
            timers.discard(due)
            out += processor.handleExpiredTimer(key, now, None)
        return out, timers

    return call


def test_clients_that_share_a_state_equal_clients_of_their_own():
    import pandas as pd

    rng, limits, clients = random.Random(9), sessions.Limits(4000, 3), [("p", None), (None, "z"), *[(f"p{i % 3}", f"c{i}") for i in range(60)]]
    own, shared, frames = {}, {}, 0
    alone = {c: _called(sessions.SessionProcessor(1800, 200_000, limits), c, own) for c in clients}
    together = _called(sessions.SharesProcessor(1800, 200_000, limits), (3,), shared)
    emitted, number, clock = [], 0, 0
    for batch in range(14):
        rows = []
        for _ in range(150 if batch < 9 else 0):
            t, number = 300_000 + batch * 1500 + rng.randrange(-2500, 1500) // 7 * 7, number + 1
            rows.append((*rng.choice(clients[: rng.choice([4, len(clients)])]), f"h{number:04}", "n", rng.choice([None, "/x"]), pd.Timestamp(t, unit="s"), rng.choice([None, None, "", "u", "v"]), rng.choice([None, "x"]), None))
        rows = pd.DataFrame([*rows, ("p", "clock", None, None, None, pd.Timestamp(300_000, unit="s"), None, None, None)], columns=sessions.KEY + sessions.FIELDS)
        got, timers = together(rows, clock)
        of = list(zip(rows["property_id"], rows["client_id"]))
        want = [f for c in clients for f in alone[c](rows[[x == c for x in of]][sessions.FIELDS], clock)[0]]
        cell = lambda v: "-" if v is None or v != v else str(int(v)) if isinstance(v, (float, np.number)) else str(v)
        plain = lambda fs: sorted(tuple(map(cell, r)) for f in fs for r in f[sessions._COLUMNS].astype(object).itertuples(index=False, name=None))
        assert plain(got) == plain(want) and len(got) <= 2, batch  # a frame of late hits, one of closed parts
        emitted += [r for f in got for r in f["id"]]
        clock = 300_000 + (batch + 1) * 1500 if batch < 9 else clock + 4000
        frames += len(got)
    assert len(emitted) == len(set(emitted)) == number and frames < 28
    assert not timers and not any(s.held for s in shared.values())  # all is forgotten
