"""Columns of an event that look at its whole session: window functions over one partitioning and one order."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SESSION = ["property_id", "client_id", "proto_seq", "split_idx"]


class SessionWindows:
    """Windows of a session; all share partitioning and, where ordered, the order by time and id."""

    def __init__(self, keys: list[str] = SESSION, ts: str = "ts", tie: str = "id", page_view: str = "page_view", name: str = "name"):
        self.keys, self.ts = keys, ts
        self.ordered = Window.partitionBy(*keys).orderBy(ts, tie)
        self.upto = self.ordered.rowsBetween(Window.unboundedPreceding, 0)
        self.onward = self.ordered.rowsBetween(0, Window.unboundedFollowing)
        self.whole = self.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        self.every = Window.partitionBy(*keys)
        self.is_page = F.col(name) == page_view
        self.name = name

    # Events of a session
    def hit_number(self) -> Column:
        return (F.row_number().over(self.ordered) - 1).cast("bigint")

    def page_number(self, location: str = "page_location") -> Column:
        """Changes of the page so far; needs _prev_location = lag(location) (windows don't nest)."""
        return F.sum(F.when(F.col(location) != F.col("_prev_location"), 1).otherwise(0)).over(self.upto)

    def page_chain(self, value: str) -> Column:
        """The value at the latest page view so far, null included."""
        return F.last(F.when(self.is_page, F.struct(F.col(value).alias("v"))), ignorenulls=True).over(self.upto)["v"]

    def entry_page(self) -> Column:
        return F.coalesce(F.col("_rn") == F.min(F.when(self.is_page, F.col("_rn"))).over(self.every), F.lit(False))

    def exit_page(self) -> Column:
        return F.coalesce(F.col("_rn") == F.max(F.when(self.is_page, F.col("_rn"))).over(self.every), F.lit(False))

    def page_bounce(self) -> Column:
        return F.coalesce(self.is_page & (F.count_if(self.is_page).over(self.every) == 1), F.lit(False))


def add_page_flow(df, w: SessionWindows | None = None, location: str = "page_location", title: str = "page_title"):
    """Append session_hit_number, session_page_number, previous and next pages, entry, exit, bounce, time_on_page.

    The page chain collapses runs of one value (null is a value); previous and next are the values of the runs beside.
    time_on_page: segments begin at the first event and at each page view and last until the next one or the session's end.
    """
    w = w or SessionWindows()
    df = df.withColumns({"_rn": w.hit_number(), "_prev_location": F.lag(location).over(w.ordered), "_c_location": w.page_chain(location), "_c_title": w.page_chain(title)})
    steps = {}
    for part in ("location", "title"):
        chain = F.col(f"_c_{part}")
        steps[f"_lag_{part}"], steps[f"_lead_{part}"] = F.lag(F.struct(chain.alias("x"))).over(w.ordered), F.lead(F.struct(chain.alias("x"))).over(w.ordered)
    starts = F.when((F.col("_rn") == 0) | w.is_page, F.col(w.ts))
    steps["_start"] = F.last(starts, ignorenulls=True).over(w.upto)
    df = df.withColumns(steps)
    out = {"session_hit_number": F.col("_rn"), "session_page_number": w.page_number(location).cast("bigint")}
    for part in ("location", "title"):
        chain, before, after = F.col(f"_c_{part}"), F.col(f"_lag_{part}"), F.col(f"_lead_{part}")
        out[f"previous_page_{part}"] = F.last(F.when(before.isNotNull() & ~chain.eqNullSafe(before["x"]), before), ignorenulls=True).over(w.upto)["x"]
        out[f"next_page_{part}"] = F.first(F.when(after.isNotNull() & ~chain.eqNullSafe(after["x"]), after), ignorenulls=True).over(w.onward)["x"]
    out["session_is_entry_page"], out["session_is_exit_page"], out["page_is_bounce"] = w.entry_page(), w.exit_page(), w.page_bounce()
    out["_end"] = F.coalesce(F.min(starts).over(w.ordered.rowsBetween(1, Window.unboundedFollowing)), F.max(w.ts).over(w.every))
    df = df.withColumns(out)
    df = df.withColumn("time_on_page", F.floor((F.unix_micros("_end") - F.unix_micros("_start")) / 1_000_000).cast("bigint"))
    return df.drop("_rn", "_prev_location", "_start", "_end", *[f"{step}_{part}" for step in ("_c", "_lag", "_lead") for part in ("location", "title")])
