"""Sessions from hits: gap time-outs, identity joining, splitting, late hits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components, settled
from .lookups import small

CLIENT = ["property_id", "client_id"]


#: Hits of one client from which on its sessions are found by ranges of time, and the ranges that it is dealt to.
HOT_HITS, CLIENT_RANGES = 1_000_000, 64


def hot_clients(events: DataFrame, key: list[str], ts: str = "ts", hot_hits: int = HOT_HITS, ranges: int = CLIENT_RANGES) -> DataFrame | None:
    """The clients with more than hot_hits hits and the times that cut each of them into ranges of about equal hits; None if there are none.
    One row for each hot_hits hits at most."""
    many = events.groupBy(*key).count().where(F.col("count") > hot_hits).select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(key)])
    if many.isEmpty():
        return None
    same = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(key)]
    own = events.join(small(many), same, "left_semi").withColumn("_us", F.unix_micros(ts))
    cuts = own.groupBy(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(key)]).agg(F.percentile_approx("_us", [i / ranges for i in range(1, ranges)]).alias("_cuts"))
    return settled(cuts)


def sessionize(events: DataFrame, timeout_s: int = 1800, key: list[str] = CLIENT, ts: str = "ts", tie: str = "id", hot_hits: int | None = HOT_HITS, clients: DataFrame | None = None) -> DataFrame:
    """Append proto_seq, the number from 0 of the session of its key: a new one where more than timeout_s passed.

    One exchange on the key; every later window over key and proto_seq reuses it. A client with more than hot_hits hits (None: don't
    look for them) is dealt to tasks by ranges of time: its sessions are numbered within each range, and a range's bounds and number of
    sessions tell, by a prefix over the ranges, where the numbers go on and whether a session runs across the border.

    clients: the client ids of all hits, and maybe of more, where they can be read at less cost; if none has so many there, events aren't
    counted. It decides about the plan alone, never about results.
    """
    micros = F.unix_micros(ts)
    none = hot_hits is None or (clients is not None and clients.groupBy(*clients.columns).count().where(F.col("count") > hot_hits).isEmpty())
    hot = None if none else hot_clients(events, key, ts, hot_hits)
    if hot is None:
        w = Window.partitionBy(*key).orderBy(ts, tie)
        new = F.coalesce((micros - F.lag(micros).over(w) > timeout_s * 1_000_000).cast("int"), F.lit(0))
        return events.withColumn("_new", new).withColumn("proto_seq", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    own = [f"_h{i}" for i in range(len(key))]
    same = [F.col(k).eqNullSafe(F.col(h)) for k, h in zip(key, own)]
    dealt = events.join(small(hot), same, "left").withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < micros)), F.lit(0))).drop(*own)
    w = Window.partitionBy(*key, "_range").orderBy(ts, tie)
    new = F.coalesce((micros - F.lag(micros).over(w) > timeout_s * 1_000_000).cast("int"), F.lit(0))
    flagged = dealt.withColumn("_new", new)
    # Of the hot clients alone: a row for each range.
    borders = flagged.where("_cuts is not null").groupBy(*[F.col(k).alias(h) for k, h in zip(key, own)], F.col("_range").alias("_r")).agg(F.min(micros).alias("_first"), F.max(micros).alias("_last"), F.sum("_new").alias("_news"))
    by_range = Window.partitionBy(*own).orderBy("_r")
    opens = F.coalesce((F.col("_first") - F.lag("_last").over(by_range) > timeout_s * 1_000_000).cast("int"), F.lit(0))
    borders = borders.withColumn("_opens", opens).withColumn("_start", F.sum(F.col("_opens") + F.col("_news")).over(by_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_news"))
    borders = small(settled(borders.select(*own, "_r", "_start")))
    numbered = flagged.withColumn("_local", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.join(borders, [*same, F.col("_range") == F.col("_r")], "left")
    return joined.withColumn("proto_seq", F.coalesce("_start", F.lit(0)) + F.col("_local")).drop(*own, "_r", "_start", "_range", "_cuts", "_new", "_local")


#: Ranges of arrival by which a property's hits are dealt out.
RANGES = 128


def drop_late(events: DataFrame, timeout_s: int = 1800, arrival: str = "arrival", ts: str = "ts", tie: str = "id", ranges: int = RANGES) -> DataFrame:
    """Append is_late: the session that the hit would belong to closed before it arrived (its time-out lies behind the clock).

    The clock is the largest time seen in earlier arrivals of the property: the largest of the ranges of arrival before the hit's own,
    and of what came before it in its own. So a property with most of the hits is shared by `ranges` tasks.
    """
    seconds = F.unix_seconds(ts)
    cuts = events.groupBy(F.col("property_id").alias("_p")).agg(F.percentile_approx(arrival, [i / ranges for i in range(1, ranges)]).alias("_cuts"))
    dealt = events.join(small(cuts), events["property_id"].eqNullSafe(F.col("_p")), "left").withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(arrival)))).drop("_p", "_cuts")
    top = dealt.groupBy(F.col("property_id").alias("_p"), F.col("_range").alias("_r")).agg(F.max(seconds).alias("_top"))
    before = Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    top = top.select("_p", "_r", F.max("_top").over(before).alias("_before"))
    own = Window.partitionBy("property_id", "_range").orderBy(arrival, tie).rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.withColumn("_seen", F.max(seconds).over(own)).join(small(top), F.col("property_id").eqNullSafe(F.col("_p")) & (F.col("_range") == F.col("_r")), "left")
    return seen.withColumn("is_late", F.coalesce(seconds + timeout_s <= F.greatest("_seen", "_before"), F.lit(False))).drop("_range", "_seen", "_p", "_r", "_before")


def isolated_id(*parts: str):
    """sha256 over parts joined by |."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def session_stamp(headers: list[str], ip: str = "ip_address", prop: str = "property_id", ts: str = "ts", explicit: str | None = None):
    """Fingerprint of a visitor for one UTC day; an explicit stamp of the request comes first."""
    daily = isolated_id(*headers, ip, prop, F.date_format(ts, "yyyy-MM-dd"))
    return daily if explicit is None else F.when(F.coalesce(F.col(explicit), F.lit("")) != "", isolated_id(explicit, prop)).otherwise(daily)


#: Headers that tell visitors apart, in the order in which they enter a stamp (fixed values).
STAMP_HEADERS = (
    "Accept", "Accept-Encoding", "Accept-Language", "User-Agent", "Sec-Ch-Ua", "Sec-Ch-Ua-Mobile", "Sec-Ch-Ua-Platform", "Sec-Ch-Ua-Platform-Version", "Sec-Ch-Ua-Model", "Sec-Ch-Ua-Full-Version",
)
#: Parameter by which a request brings a stamp of its own (fixed value).
STAMP_PARAM = "fss"


def request_stamp(headers: tuple[str, ...] = STAMP_HEADERS, explicit: str | None = STAMP_PARAM) -> Column:
    """session_stamp of a hit: of the request's own parameter, else of the first values of the headers, the address and the UTC day."""
    first = lambda m, k: F.coalesce(F.get(F.try_element_at(m, F.lit(k)), F.lit(0)), F.lit(""))
    parts = [first("headers", h) for h in headers] + [F.coalesce("ip_address", F.lit("")), F.coalesce("property_id", F.lit("")), F.date_format("ts", "yyyy-MM-dd")]
    daily = F.sha2(F.concat_ws("|", *parts), 256)
    if explicit is None:
        return daily
    own = first("query_params", explicit)
    return F.when(own != "", F.sha2(F.concat(F.lit(f"{explicit}="), own, F.lit("|"), F.coalesce("property_id", F.lit(""))), 256)).otherwise(daily)


#: Entries of the fold's state at which keys of closed sessions are cleared out first.
STITCH_STATE = 100_000


def _owners(batches: Iterator[tuple[pd.Series, ...]], timeout_s: int, stamps: bool, users: bool) -> Iterator[pd.Series]:
    """Rows (group, time, client, stamp, user) come sorted by group and time: each key's first owner keeps it until the owner's
    session is over. Rows without a group keep their client.

    The state is the open sessions and their keys, so memory doesn't grow with the hits.
    """
    gap, now, limit = timeout_s * 1_000_000, None, STITCH_STATE
    owner: dict[tuple, tuple] = {}  # key -> client and start of the client's session
    spans: dict[str, list] = {}  # client -> start and latest hit of its session

    def span(client: str, ts: int) -> list:
        if client not in spans or ts - spans[client][1] > gap:
            spans[client] = [ts, ts]
        return spans[client]

    def is_open(client: str, start: int, ts: int) -> bool:
        return client in spans and spans[client][0] == start and ts - spans[client][1] <= gap

    for groups, times, clients, stamp_of, user_of in batches:
        out = clients.tolist()
        asked = np.flatnonzero(groups.notna().to_numpy())
        for i, g, ts, stamp, user in zip(asked.tolist(), *(c.iloc[asked].tolist() for c in (groups, times, stamp_of, user_of))):
            client = out[i]
            if g != now:
                now, owner, spans = g, {}, {}
            found = client
            for on, kind, value in ((stamps, "stamp", stamp), (users, "user", user)):
                if not on or not value:
                    continue
                held = owner.get((kind, value))
                if held is None or not is_open(*held, ts):
                    owner[kind, value] = (client, span(client, ts)[0])
                elif held[0] != client:
                    found = held[0]
            span(found, ts)[1] = ts
            out[i] = found
            if len(owner) + len(spans) > limit:
                owner = {k: h for k, h in owner.items() if is_open(*h, ts)}
                spans = {c: s for c, s in spans.items() if ts - s[1] <= gap}
                limit = max(STITCH_STATE, 2 * (len(owner) + len(spans)))
        yield pd.Series(out, dtype=object)


def _node(kind: str, *columns: str) -> Column:
    return F.xxhash64(F.lit(kind), *columns)


#: Hits of one group that a single task may fold.
FOLD_ROWS = 1_000_000


def stitching_groups(events: DataFrame, timeout_s: int, by_stamp: bool, by_user: bool, fold_rows: int = FOLD_ROWS, rounds: int = 3) -> DataFrame:
    """Append _group: hits that can bear on each other's owners have the same one; null for clients that share no key.

    A property is one group. Where it has more than fold_rows hits, its clients are joined by the stamps and user ids that they share
    (connected components); a component is cut where none of its hits falls into a whole time-out, since all its sessions are closed
    there. Clients of groups that are still too large are then joined anew within each piece, and pieces cut again, until a round
    brings nothing. Two values with one hash only make a group larger.

    The hits are read anew in each pass and aren't shuffled where the clients, and the components' pieces, are few enough to be broadcast: a client stands
    for all its keys by the least of them, so the graph is one of keys, and passes leave only counts behind.
    """
    keys = [c for on, c in ((by_stamp, "_stamp"), (by_user, "_user")) if on]
    df = events.withColumns({"_slot": F.floor(F.unix_micros("ts") / (timeout_s * 1_000_000)), "_p": F.col("property_id").cast("string"), "_c": F.col("client_id").cast("string")})
    df = df.withColumn("_group", F.xxhash64("_p") if keys else F.lit(None).cast("bigint"))
    sizes, seen = df.groupBy("_group").agg(F.count("*").alias("_hits")), None
    for _ in range(rounds if keys else 0):
        # One row for each fold_rows hits at most. Groups are only ever cut, so the same number of them with as many hits are the same.
        large = settled(sizes.where(F.col("_hits") > fold_rows).select(F.col("_group").alias("_large"), "_hits"))
        found = tuple(large.agg(F.count("*"), F.sum("_hits")).first())
        if not found[0] or found == seen:
            break
        seen = found
        df = df.join(small(large.drop("_hits")), F.col("_group") == F.col("_large"), "left").withColumn("_node", F.when(F.col("_large").isNotNull(), _node("client", "_large", "_c")))
        nodes = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), _node(k, "_large", k)) for k in keys]))
        edges = df.where("_large is not null").select(F.col("_node").alias("_client"), F.explode(nodes).alias("b"))
        hubs = settled(edges.groupBy("_client").agg(F.min("b").alias("a")))
        comps = components(edges.join(small(hubs), "_client").select("a", "b").distinct())
        owned = settled(hubs.join(comps, F.col("a") == F.col("node")).select(F.col("_client"), F.col("comp").alias("_comp")))
        df = df.join(small(owned), F.col("_node") == F.col("_client"), "left").drop("_client", "_node")
        slots = df.where("_comp is not null").groupBy(F.col("_comp").alias("_of"), F.col("_slot").alias("_at")).agg(F.count("*").alias("_hits"))
        order = Window.partitionBy("_of").orderBy("_at")
        fresh = F.coalesce((F.col("_at") - F.lag("_at").over(order) > 1).cast("int"), F.lit(0))
        pieces = slots.withColumn("_new", fresh).withColumn("_nth", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        pieces = settled(pieces.select("_of", "_at", F.xxhash64("_of", "_nth").alias("_next"), "_hits"))
        df = df.join(small(pieces.drop("_hits")), (F.col("_comp") == F.col("_of")) & (F.col("_slot") == F.col("_at")), "left")
        df = df.withColumn("_group", F.when(F.col("_large").isNotNull(), F.col("_next")).otherwise(F.col("_group"))).drop("_large", "_comp", "_of", "_at", "_next")
        sizes = pieces.groupBy(F.col("_next").alias("_group")).agg(F.sum("_hits").alias("_hits"))
    return df.drop("_slot", "_p", "_c")


def stitch(events: DataFrame, timeout_s: int = 1800, by_stamp: bool = True, by_user: bool = True, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Append stitched_client_id: the client that first held the hit's session stamp or user id.

    First owner wins, chains aren't followed, keys are free again once their owner's session is over. The rule is a fold over
    hits in time order; it runs within each of stitching_groups, so that a large property spreads, and takes only keys and times
    with it. stitch_by_stamp needs no fold.
    """
    names = events.columns
    keyed = events.withColumns({"_stamp": F.nullif(F.col("session_stamp").cast("string"), F.lit("")), "_user": F.nullif(F.col("user_id").cast("string"), F.lit(""))})
    grouped = stitching_groups(keyed, timeout_s, by_stamp, by_user, fold_rows)
    ordered = grouped.repartition(F.coalesce("_group", _node("client", "property_id", "client_id"))).sortWithinPartitions("_group", "ts", "id")

    @F.pandas_udf("string")
    def owners(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return _owners(batches, timeout_s, by_stamp, by_user)

    found = owners.asNondeterministic()("_group", F.unix_micros("ts"), F.col("client_id").cast("string"), "_stamp", "_user")  # its place in the order counts
    return ordered.withColumn("stitched_client_id", found).select(*names, "stitched_client_id")


def stitch_by_stamp(events: DataFrame, timeout_s: int = 1800) -> DataFrame:
    """The same with session stamps alone, set-based: the first client of each run of a stamp's hits owns the run."""
    w = Window.partitionBy("property_id", "session_stamp").orderBy("ts", "id")
    gap = F.coalesce((F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) > timeout_s * 1_000_000).cast("int"), F.lit(0))
    runs = events.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first("client_id").over(Window.partitionBy("property_id", "session_stamp", "_run").orderBy("ts", "id"))
    return runs.withColumn("stitched_client_id", F.when(F.coalesce("session_stamp", F.lit("")) == "", F.col("client_id")).otherwise(first)).drop("_gap", "_run")


SPLIT_CAUSES = ("max_time_since_first_event_reached", "max_events_reached", "user_id_changed", "utm_campaign_changed")


def _cuts(batches: Iterator[tuple[pd.Series, ...]], max_s: int, max_events: int, by_user: bool, by_campaign: bool) -> Iterator[pd.DataFrame]:
    """Rows come sorted by group and time. The state is one session's, so memory doesn't grow with it. Rows without a key need no cut."""
    held = None
    for keys, times, users, campaigns in batches:
        index, causes = np.zeros(len(keys), dtype=np.int64), np.full(len(keys), None, dtype=object)
        asked = np.flatnonzero(keys.notna().to_numpy())
        for i, key, ts, user, campaign in zip(asked.tolist(), *(c.iloc[asked].tolist() for c in (keys, times, users, campaigns))):
            cause = None
            if held is None or held[0] != key:
                held = [key, 0, ts, 0, None, None]
            else:
                if ts - held[2] >= max_s * 1_000_000:
                    cause = SPLIT_CAUSES[0]
                elif held[3] >= max_events:
                    cause = SPLIT_CAUSES[1]
                elif by_user and user is not None and held[4] is not None and user != held[4]:
                    cause = SPLIT_CAUSES[2]
                elif by_campaign and campaign is not None and held[5] is not None and campaign != held[5]:
                    cause = SPLIT_CAUSES[3]
                if cause:
                    held[1:] = [held[1] + 1, ts, 0, None, None]
            held[3] += 1
            held[4] = held[4] if user is None else user
            held[5] = held[5] if campaign is None else campaign
            index[i], causes[i] = held[1], cause
        yield pd.DataFrame({"split_idx": index, "cause": causes})


def split(events: DataFrame, max_s: int = 43_200, max_events: int = 1000, by_user: bool = True, by_campaign: bool = True, group: list[str] = [*CLIENT, "proto_seq"]) -> DataFrame:  # noqa: B006
    """Append split_idx and _split_cause (on a part's first event): sessions cut by the four conditions, first match wins.

    Windows find the sessions in which any condition can hold at all. Where a cut falls there depends on where the last one fell, so
    their keys, times, users and campaigns (no other columns) are streamed in order through a small fold; the rest is 0.
    """
    whole = Window.partitionBy(*group).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the fold's order
    user, campaign, micros = F.nullif(F.col("user_id").cast("string"), F.lit("")), F.col("utm_campaign").cast("string"), F.unix_micros("ts")
    may = (F.max(micros).over(whole) - F.min(micros).over(whole) >= max_s * 1_000_000) | (F.count("*").over(whole) > max_events)
    for on, value in ((by_user, user), (by_campaign, campaign)):
        may |= F.coalesce(F.min(value).over(whole) < F.max(value).over(whole), F.lit(False)) if on else F.lit(False)
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(g).cast("string"), F.lit("\u0002")) for g in group])
    # The window above has brought each group to one task; the sort is free where the input has it already.
    ordered = events.withColumn("_may", may).sortWithinPartitions(*group, "ts", "id")

    @F.pandas_udf("split_idx long, cause string")
    def cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return _cuts(batches, max_s, max_events, by_user, by_campaign)

    cut = cuts.asNondeterministic()(F.when(F.col("_may"), key), micros, user, campaign)  # its place in the order counts
    return ordered.withColumn("_cut", cut).withColumns({"split_idx": F.col("_cut.split_idx"), "_split_cause": F.col("_cut.cause")}).drop("_may", "_cut")


def split_on_change(events: DataFrame, column: str, group: list[str] = [*CLIENT, "proto_seq"]) -> DataFrame:  # noqa: B006
    """split_idx for one value-change condition alone: windows suffice."""
    w = Window.partitionBy(*group).orderBy("ts", "id")
    value = F.nullif(F.col(column), F.lit(""))
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    changed = F.coalesce((value != before).cast("int"), F.lit(0))
    return events.withColumn("_changed", changed).withColumn("split_idx", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")
