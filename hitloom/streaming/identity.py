"""Identity stitching in a stream: an operator in front of the sessions that owns the identifiers.

A session stamp or user id belongs to the first client that brings it, until that client's session is over; hits of other clients with it
are given that client. The rule is the one of operators.sessionize.stitch. Rows of a micro-batch are taken in time order, later batches
after earlier ones. The state of a property is its open sessions and their identifiers: both are dropped by timer once no hit that
isn't late could still find them open. Late hits keep their client and own nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType


class OwnerProcessor(StatefulProcessor):
    """owners: identifier -> client and start of the session that owns it; spans: client -> start and latest hit of its session.

    What a batch touches is read once and written once, so the work follows the hits and not the state."""

    def __init__(self, columns: list[str], timeout_s: int, behind_s: int, kinds: list[str]):
        self.columns, self.gap, self.behind_ms, self.kinds = columns, timeout_s * 1_000_000, behind_s * 1000, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.owners = handle.getMapState("owners", "identifier string", "client string, start long")
        self.spans = handle.getMapState("spans", "client string", "start long, last long")
        self.swept = handle.getValueState("sweep", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        mark = timerValues.getCurrentWatermarkInMs()
        clock = (mark + self.behind_ms) * 1000 if mark > 0 else 0
        owners, spans = _Touched(self.owners), _Touched(self.spans)

        def span(client: str, at: int) -> tuple[int, int]:
            """The client's open session, a new one if there is none."""
            found = spans[client]
            if found is None or at - found[1] > self.gap:
                found = spans[client] = (at, at)
            return found

        def is_open(client: str, start: int, at: int) -> bool:
            found = spans[client]
            return found is not None and found[0] == start and at - found[1] <= self.gap

        given = []
        times = batch["ts"].astype("datetime64[us]").astype("int64").tolist()
        for at, client, *identifiers in zip(times, batch["client_id"], *(batch[c] for c in self.kinds)):
            if at + self.gap <= clock:  # late: its session is over
                given.append(client)
                continue
            taken = client
            for kind, value in zip(self.kinds, identifiers):
                if not isinstance(value, str) or not value:
                    continue
                name = f"{kind}|{value}"
                held = owners[name]
                if held is None or not is_open(*held, at):
                    owners[name] = (client, span(client, at)[0])
                elif held[0] != client:
                    taken = held[0]
            start, last = span(taken, at)
            spans[taken] = (start, max(last, at))
            given.append(taken)
        owners.write(), spans.write()
        if times and not self.swept.exists():
            self._sweep_after(times[0] // 1000)
        yield batch.assign(stitched_client_id=given)[self.columns]

    def _sweep_after(self, at_ms: int) -> None:
        due = at_ms + 2 * self.gap // 1000 + 1 - self.behind_ms  # on the watermark's scale
        self.handle.registerTimer(due)
        self.swept.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Sessions by whose end two time-outs have passed, and what they own, go."""
        self.swept.clear()
        clock = (timerValues.getCurrentWatermarkInMs() + self.behind_ms) * 1000
        kept, gone = {}, []
        for (client,), (start, last) in list(self.spans.iterator()):
            if last + 2 * self.gap <= clock:
                gone.append(client)
            else:
                kept[client] = (start, last)
        lost = [name for (name,), (client, start) in list(self.owners.iterator()) if client not in kept or kept[client][0] != start]
        for client in gone:
            self.spans.removeKey((client,))
        for name in lost:
            self.owners.removeKey((name,))
        if kept:
            self._sweep_after(min(last for _, last in kept.values()) // 1000)
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


class _Touched(dict):
    """Entries of a state map that a batch reads or writes."""

    def __init__(self, state):
        super().__init__()
        self.state, self.changed = state, set()

    def __missing__(self, name):
        found = tuple(self.state.getValue((name,))) if self.state.containsKey((name,)) else None
        dict.__setitem__(self, name, found)
        return found

    def __setitem__(self, name, value):
        dict.__setitem__(self, name, value)
        self.changed.add(name)

    def write(self) -> None:
        for name in self.changed:
            self.state.updateValue((name,), dict.__getitem__(self, name))


def stitched(hits: DataFrame, timeout_s: int = 1800, behind_s: int = 88_200, by_stamp: bool = True, by_user: bool = True) -> DataFrame:
    """hits (with a watermark of behind_s on ts) and stitched_client_id. A property's identifiers are one key of the state, as its clients can
    all meet. Heartbeats (see sessions.real_hit) must be left out."""
    kinds = [c for on, c in ((by_stamp, "session_stamp"), (by_user, "user_id")) if on]
    shaped = hits.withColumns({c: F.col(c).cast("string") for c in kinds})
    schema = StructType([*shaped.schema.fields, StructField("stitched_client_id", StringType())])
    out = OwnerProcessor(schema.fieldNames(), timeout_s, behind_s, kinds)
    return shaped.groupBy("property_id").transformWithStateInPandas(out, schema, "Append", "EventTime", eventTimeColumnName="ts")
