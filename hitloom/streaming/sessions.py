"""Streaming sessions: hits of a key are held in state until their session's time-out passes on the event-time clock.

A session, or a part of one that a limit has cut off, leaves as soon as nothing can change it any more: the session when the clock has passed
its last hit by the time-out, the part when it has passed the first hit of the next part by the time-out, since every hit that would come
before that one is late by then. So a client that never rests holds no more than its open part and one time-out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.sessionize import SPLIT_CAUSES

KEY, FIELDS = ["property_id", "client_id"], ["id", "name", "page_location", "ts", "user_id", "utm_campaign", "payload"]
HIT = "id string, name string, page_location string, ts timestamp, user_id string, utm_campaign string, payload string"
MORE = "session_id string, proto_seq long, split_idx long, session_split_cause string, session_hit_number long, session_total_events long, session_duration long, is_late boolean"
OUT = f"property_id string, client_id string, {HIT}, {MORE}"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
#: Shares into which a stream's clients are dealt, each with one state.
SHARES = 256
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Limits:
    """What cuts an open session into parts; as operators.sessionize.split has it."""

    max_s: int = 43_200
    max_events: int = 1000
    by_user: bool = True
    by_campaign: bool = True


def first_cut(times: np.ndarray, users: list, campaigns: list, limits: Limits) -> tuple[int, str | None]:
    """How many hits the first part of a session has, and why the next part begins there."""
    n = len(times)
    found = [(min(int(np.searchsorted(times, times[0] + limits.max_s * 1_000_000)), n), 0), (min(limits.max_events, n), 1)]
    for on, values, cause in ((limits.by_user, users, 2), (limits.by_campaign, campaigns, 3)):
        if on:
            known = [(i, v) for i, v in enumerate(values) if v is not None]
            found.append((next((i for i, v in known if v != known[0][1]), n), cause))
    at, cause = min(found)
    return at, SPLIT_CAUSES[cause] if at < n else None


def parts_of(times: np.ndarray, users: list, campaigns: list, timeout_s: int, limits: Limits | None, before: tuple[int, int, int, str | None] | None) -> Iterator[tuple[int, int, int, int, str | None]]:
    """start, end, number of the session, of its part, and why the part begins, of a key's hits in order. before: the last hit that has left,
    its session's number, and the number and cause of the part that comes next there."""
    last, seq, index, cause = before or (None, -1, 0, None)
    at, rests = 0, np.flatnonzero(np.diff(times) > timeout_s * 1_000_000) + 1
    while at < len(times):
        if last is None or times[at] - last > timeout_s * 1_000_000:
            seq, index, cause = seq + 1, 0, None
        rest = rests.searchsorted(at, "right")
        end = int(rests[rest]) if rest < len(rests) else len(times)
        size, then = first_cut(times[at:end], users[at:end], campaigns[at:end], limits) if limits else (end - at, None)
        yield at, at + size, seq, index, cause
        last, index, cause, at = times[at + size - 1], index + 1, then, at + size


class SessionProcessor(StatefulProcessor):
    """State of a key: the hits of its open sessions, the time for which its timer stands, and where the last part that left ended.

    A part comes out whole, in time order, when its time has come; a hit whose session is over by the clock comes out at once, marked as late.
    The clock is the largest time seen: the watermark trails it by behind_s, so that late hits still reach the processor."""

    def __init__(self, timeout_s: int = 1800, behind_s: int = 88_200, limits: Limits | None = None):
        self.timeout_s, self.behind_ms, self.limits = timeout_s, behind_s * 1000, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", HIT)
        self.due = handle.getValueState("due", "at long")
        self.left = handle.getValueState("left", "last long, seq long, next long, cause string")

    def wake(self, at_ms: int) -> None:
        """A timer for this time of the clock, unless an earlier one stands."""
        at = at_ms - self.behind_ms  # on the watermark's scale
        now = self.due.get()[0] if self.due.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        clock = mark + self.behind_ms if mark > 0 else 0
        first, late = None, []
        for batch in rows:
            batch = batch[batch["id"].notna()]
            at = batch["ts"].astype("datetime64[ms]").astype("int64")
            over = at + self.timeout_s * 1000 <= clock
            if over.any():
                late.append(batch.loc[over, FIELDS])
            held = batch.loc[~over, FIELDS]
            if len(held):
                self.hits.appendList(list(held.astype(object).where(held.notna(), None).itertuples(index=False, name=None)))
                first = min(int(at[~over].min()), first) if first is not None else int(at[~over].min())
        if first is not None:
            self.wake(first + self.timeout_s * 1000 + 1)  # nothing of these can leave before that
        for some in late:
            yield some.assign(property_id=key[0], client_id=key[1], session_id=None, proto_seq=None, split_idx=None, session_split_cause=None, session_hit_number=0, session_total_events=0, session_duration=0, is_late=True)[_COLUMNS]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        clock_us = (timerValues.getCurrentWatermarkInMs() + self.behind_ms) * 1000
        held = pd.DataFrame(list(self.hits.get()), columns=FIELDS).sort_values(["ts", "id"], kind="stable").reset_index(drop=True)
        if held.empty:
            self.left.clear()
            return
        times = held["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        plain = lambda c: [None if v is None or v != v or v == "" and c == "user_id" else v for v in held[c]]
        before = tuple(self.left.get()) if self.left.exists() else None
        gap, gone, wake, closed, last = self.timeout_s * 1_000_000, 0, None, [], None
        parts = list(parts_of(times, plain("user_id"), plain("utm_campaign"), self.timeout_s, self.limits, before))
        for k, (start, end, seq, index, cause) in enumerate(parts):
            follows = k + 1 < len(parts) and parts[k + 1][2] == seq
            final = times[end] + gap if follows else times[end - 1] + gap + 1000  # a part: by the next one's first hit; a session: by its last
            if final > clock_us:
                wake = int(final // 1000) + 1
                break
            gone = end
            closed.append((end - start, held["id"].iat[start], seq, index, cause, int(times[end - 1] // 1_000_000 - times[start] // 1_000_000)))
            then = parts[k + 1] if follows else None
            last = (int(times[end - 1]), seq, then[3] if then else 0, then[4] if then else None)
        if closed:  # one frame and one update of the state for all parts that leave
            size, *values = zip(*closed)
            each = dict(zip(("session_id", "proto_seq", "split_idx", "session_split_cause", "session_duration"), (np.repeat(np.array(v, dtype=object), size) for v in values)))
            number = np.arange(gone) - np.repeat(np.cumsum(size) - size, size)
            yield held.iloc[:gone].assign(property_id=key[0], client_id=key[1], **each, session_hit_number=number, session_total_events=np.repeat(size, size), is_late=False)[_COLUMNS]
            self.left.update(last)
        if gone:
            rest = held.iloc[gone:]
            self.hits.clear()
            if len(rest):
                self.hits.appendList(list(rest.astype(object).where(rest.notna(), None).itertuples(index=False, name=None)))
        if wake is not None:
            self.wake(wake)
        elif self.left.exists():
            self.wake(int(self.left.get()[0] // 1000) + 2 * self.timeout_s * 1000 + 1)  # then the key can be forgotten

    def close(self) -> None:
        pass


class SharesProcessor(StatefulProcessor):
    """The same for many clients at once: the key is a share, the rest of a hash of property and client. Calls, state and frames are a share's, so
    their number doesn't grow with the clients. State of a share: its open hits as Arrow data, a value for each micro-batch that brought some;
    where the last part of each client that left ended; the time for which the timer stands."""

    def __init__(self, timeout_s: int = 1800, behind_s: int = 88_200, limits: Limits | None = None):
        self.timeout_s, self.behind_ms, self.limits = timeout_s, behind_s * 1000, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "hits binary")
        self.due = handle.getValueState("due", "at long")
        self.left = handle.getValueState("left", "clients binary")

    wake = SessionProcessor.wake

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        clock = mark + self.behind_ms if mark > 0 else 0
        batch = pd.concat(list(rows), ignore_index=True)[KEY + FIELDS]
        batch = batch[batch["id"].notna()]
        at = batch["ts"].astype("datetime64[ms]").astype("int64")
        over = at + self.timeout_s * 1000 <= clock
        if not over.all():
            self.hits.appendValue((_packed(batch[~over], _HITS),))
            self.wake(int(at[~over].min()) + self.timeout_s * 1000 + 1)  # nothing of these can leave before that
        if over.any():
            yield batch[over].assign(session_id=None, proto_seq=None, split_idx=None, session_split_cause=None, session_hit_number=0, session_total_events=0, session_duration=0, is_late=True)[_COLUMNS]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        clock_us = (timerValues.getCurrentWatermarkInMs() + self.behind_ms) * 1000
        gap = self.timeout_s * 1_000_000
        left = {(p, c): last for p, c, *last in zip(*_unpacked([self.left.get()[0]], _LEFT).to_pydict().values())} if self.left.exists() else {}
        held = _unpacked([blob for (blob,) in self.hits.get()], _HITS).to_pandas()
        held = held.assign(_of=held.groupby(KEY, sort=False, dropna=False).ngroup()).sort_values(["_of", "ts", "id"], kind="stable", ignore_index=True)
        times = held["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        users, campaigns = ([None if v is None or v != v or v == "" and c == "user_id" else v for v in held[c]] for c in ("user_id", "utm_campaign"))
        edges = [*np.flatnonzero(np.diff(held["_of"], prepend=-1)).tolist(), len(held)]
        clients = [tuple(None if v != v else v for v in row) for row in held.loc[edges[:-1], KEY].itertuples(index=False, name=None)]
        closed, wakes, open_ = [], [], set()
        for client, a, b in zip(clients, edges, edges[1:]):
            last = left.get(client)
            parts = list(parts_of(times[a:b], users[a:b], campaigns[a:b], self.timeout_s, self.limits, tuple(last) if last else None))
            for k, (start, end, seq, index, cause) in enumerate(parts):
                follows = k + 1 < len(parts) and parts[k + 1][2] == seq
                final = times[a + end] + gap if follows else times[a + end - 1] + gap + 1000  # a part: by the next one's first hit; a session: by its last
                if final > clock_us:
                    wakes.append(int(final // 1000) + 1)
                    open_.add(client)
                    break
                closed.append((a + start, a + end, seq, index, cause))
                left[client] = (int(times[a + end - 1]), seq, *(parts[k + 1][3:] if follows else (0, None)))
        ends = {client: last[0] // 1000 + 2 * self.timeout_s * 1000 + 1 for client, last in left.items() if client not in open_}
        for client, at in ends.items():  # a client that rests can be forgotten
            if at * 1000 <= clock_us:
                del left[client]
            else:
                wakes.append(at)
        if closed:
            starts, stops, seqs, indexes, causes = (np.array(v, dtype=object if k == 4 else np.int64) for k, v in enumerate(zip(*closed)))
            size = stops - starts
            number = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            rows = number + np.repeat(starts, size)
            each = {"session_id": held["id"].to_numpy()[starts], "proto_seq": seqs, "split_idx": indexes, "session_split_cause": causes, "session_total_events": size, "session_duration": times[stops - 1] // 1_000_000 - times[starts] // 1_000_000}
            yield held.iloc[rows].assign(**{c: np.repeat(v, size) for c, v in each.items()}, session_hit_number=number, is_late=False)[_COLUMNS]
            self.hits.clear()
            if len(rows) < len(held):
                self.hits.appendValue((_packed(held.drop(index=rows), _HITS),))
        if left:
            columns = zip(*((*client, *last) for client, last in left.items()))
            self.left.update((_packed(pd.DataFrame(dict(zip(_LEFT.names, columns))), _LEFT),))
        else:
            self.left.clear()
        if wakes:
            self.wake(min(wakes))

    def close(self) -> None:
        pass


_HITS = pa.schema([(c, pa.timestamp("us") if c == "ts" else pa.string()) for c in KEY + FIELDS])
_LEFT = pa.schema([("property_id", pa.string()), ("client_id", pa.string()), ("last", pa.int64()), ("seq", pa.int64()), ("next", pa.int64()), ("cause", pa.string())])


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False))
    return out.getvalue().to_pybytes()


def _unpacked(blobs: list[bytes], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(blob).read_all() for blob in blobs)])


def real_hit():
    """Not a heartbeat. It asks for the time too, else Spark would leave heartbeats out before it has seen their time."""
    return F.col("id").isNotNull() | F.col("ts").isNull()


def stream_sessions(hits: DataFrame, timeout_s: int = 1800, grace_s: int = 86_400, limits: Limits | None = None, join_by_stamp: bool = False, join_by_user: bool = False, shares: int = SHARES) -> DataFrame:
    """Closed sessions of a stream of hits (property_id, client_id, id, name, page_location, ts, for limits user_id and utm_campaign, to join
    clients session_stamp and user_id, and any other columns, which pass through), a row for each event; with limits, the parts of sessions as
    they are cut. Late hits come out with is_late, for a sink of their own, by the same clock that closes the sessions. Hits that are
later than that by more than grace_s are dropped by Spark, which counts them.

    Clients are dealt to `shares` states, so that calls and frames are few and large; a share's open hits must fit one Python process. With 0 shares a client
    has a state of its own: for streams whose batches touch few of the open clients.

    Needs the RocksDB state store. Heartbeats (rows with a null id) only move the clock; union them in to close idle sessions.
    """
    spark = hits.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    marked = hits.withWatermark("ts", f"{timeout_s + grace_s} seconds")
    joined = join_by_stamp or join_by_user
    if joined:
        from .identity import stitched

        marked = stitched(marked.where(real_hit()), timeout_s, timeout_s + grace_s, join_by_stamp, join_by_user).withColumnsRenamed({"client_id": "own_client_id", "stitched_client_id": "client_id"})
    more = [f for f in marked.schema.fields if f.name not in {*KEY, *(set(FIELDS) - {"user_id", "utm_campaign"})}]
    payload = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in more])) if more else F.lit(None).cast("string")
    text = {c: F.col(c).cast("string") if c in marked.columns else F.lit(None).cast("string") for c in ("user_id", "utm_campaign")}
    stamped = marked.withColumn("payload", payload).withColumns(text).select(*KEY, *FIELDS)
    stamped = stamped if joined else stamped.where(real_hit())
    if shares:
        dealt = stamped.withColumn("share", F.pmod(F.xxhash64(*KEY), F.lit(shares)))
        out = dealt.groupBy("share").transformWithStateInPandas(SharesProcessor(timeout_s, timeout_s + grace_s, limits), OUT, "Append", "EventTime")
    else:
        out = stamped.groupBy(*KEY).transformWithStateInPandas(SessionProcessor(timeout_s, timeout_s + grace_s, limits), OUT, "Append", "EventTime")
    given = {f.name for f in more}
    out = out.drop(*[c for c in ("user_id", "utm_campaign") if c not in marked.columns or c in given])
    if not more:
        return out.drop("payload")
    return out.withColumn("payload", F.from_json("payload", StructType(more))).select("*", *[F.col(f"payload.`{f.name}`").alias(f.name) for f in more]).drop("payload")


def write_wide(options, write_events, write_late, **lookups):
    """foreachBatch function over stream_sessions: every closed session, or part of one, of the batch becomes wide rows by the batch plan (they
    are whole), late hits go to write_late. The hits need the columns that build_events asks for.

    lookups: tables for build_events, or functions that give one; a function is asked in each batch, so a new version of the table is
    used from the next batch on (see operators.lookups.Snapshots).
    """
    from ..plans.pipeline import build_events

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        closed = batch.where("not is_late").drop("session_id", "session_hit_number", "session_total_events", "session_duration", "is_late")
        tables = {name: t() if callable(t) else t for name, t in lookups.items()}
        write_events(build_events(closed.withColumnRenamed("session_split_cause", "_split_cause"), options, **tables), number)
        write_late(batch.where("is_late"), number)
        batch.unpersist()

    return write


def stream_counts(hits: DataFrame, gap: str = "30 minutes", delay: str = "0 seconds") -> DataFrame:
    """Events and bounds of each session by Spark's session windows: no Python, partial aggregation."""
    w = F.session_window("ts", gap)
    return hits.withWatermark("ts", delay).groupBy("property_id", "client_id", w).agg(F.count("*").alias("session_total_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def dead_letters(hits: DataFrame, clock: str = "arrival", timeout_s: int = 1800) -> tuple[DataFrame, DataFrame]:
    """Hits in time, and late ones for a sink of their own, by an arrival clock column."""
    late = F.unix_seconds("ts") + timeout_s <= F.unix_seconds(clock)
    return hits.where(~late), hits.where(late)
