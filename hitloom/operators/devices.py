"""Device detection by a pattern database: thousands of ordered regular expressions behind one Aho-Corasick pass.

A database is a table (section, place, regex, name, version, brand, device): sections `bot`, `browser`, `system` and `model`; within a section
the first pattern that holds, by place, decides. name, version and brand may say $1 to $9 for what the pattern's groups hold. read_database takes the public YAML
lists. Of the texts that a pattern can't do without, the one is taken that fewest patterns of the list have; one pass over the agent finds which of
these it holds, and only those patterns are tried, in their order, and the few that have no such text. So an agent costs about the same whatever the
size of the list.

A database of more than MOST_PATTERNS patterns isn't sent to the tasks: the distinct agents' substrings are joined with its texts, and the patterns
that they meet are tried there; the result is the same.

What the database doesn't say comes from lookups.parse_agent: the category of what is no known model, and what client hints say.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from re import _constants as kinds
from re import _parser as parser

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import settled
from .lookups import _HINTS, DEVICE, parse_agent

DATABASE = "section string, place int, regex string, name string, version string, brand string, device string"
#: Patterns up to which a database is sent to the tasks with the plan; a larger one is joined.
MOST_PATTERNS = 200_000
#: Letters that a text must have to tell patterns apart, and agents that a process remembers.
LEAST, REMEMBERED = 3, 100_000
#: Names of device kinds in the lists, and ours (fixed values).
KINDS = {"smartphone": "smartphone", "feature phone": "smartphone", "phablet": "smartphone", "tablet": "tablet", "tv": "tv", "console": "console", "desktop": "desktop"}


def needed_texts(pattern: str) -> list[str]:
    """Texts, in lower case, that everything which the pattern matches holds. A run goes on through a group that is neither repeated nor a choice."""
    found, run = [], ""

    def end() -> None:
        nonlocal run
        found.append(run)
        run = ""

    def runs(items) -> None:
        nonlocal run
        for kind, value in items:
            if kind is kinds.LITERAL and len(chr(value).lower()) == 1 and chr(value).isascii():
                run += chr(value).lower()
            elif kind is kinds.SUBPATTERN:
                runs(value[3])
            elif kind is not kinds.AT:
                end()
                if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
                    runs(value[2])
                    end()

    runs(parser.parse(pattern, re.I))
    end()
    return [t for t in dict.fromkeys(found) if len(t) >= LEAST]


def needed_text(pattern: str) -> str:
    """The longest of needed_texts; "" if there is none."""
    return max(needed_texts(pattern), key=len, default="")


class Section:
    """Ordered patterns; find gives the first that holds, and its match."""

    def __init__(self, rows: list[dict]):
        self.rows, self.compiled, self.always = rows, {}, []
        self.texts = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        needed = [needed_texts(r["regex"]) for r in rows]
        held_by = Counter(t for texts in needed for t in texts)
        for i, texts in enumerate(needed):
            if texts:
                places.setdefault(min(texts, key=lambda t: (held_by[t], -len(t))), []).append(i)
            else:
                self.always.append(i)
        for text, held in places.items():
            self.texts.add_word(text, held)
        if places:
            self.texts.make_automaton()
        self.any = bool(places)

    def find(self, agent: str) -> tuple[dict, re.Match] | None:
        tried = set(self.always)
        if self.any:
            for _, held in self.texts.iter(agent.lower()):
                tried.update(held)
        for i in sorted(tried):
            if i not in self.compiled:
                self.compiled[i] = re.compile(self.rows[i]["regex"], re.I)
            if m := self.compiled[i].search(agent):
                return self.rows[i], m
        return None


def filled(template: str | None, m: re.Match) -> str | None:
    """A template with what the pattern's groups hold; null if nothing is left."""
    if template is None:
        return None
    groups = (None, *m.groups())
    out = re.sub(r"\$([1-9])", lambda d: (groups[int(d[1])] or "") if int(d[1]) < len(groups) else "", template).strip()
    return out or None


class Database:
    def __init__(self, rows: list[dict]):
        self.sections = {s: Section([r for r in rows if r["section"] == s]) for s in ("bot", "browser", "system", "model")}

    def parse(self, agent: str | None, *hints: str | None) -> dict:
        def find(section: str) -> dict | None:
            found = self.sections[section].find(agent)
            return found and said(*found)

        return described(find, agent, *hints)


def said(row: dict, m: re.Match) -> dict:
    """What a pattern that holds says."""
    return {c: filled(row[c], m) for c in ("name", "version", "brand")} | {"device": row["device"]}


def described(find: Callable[[str], dict | None], agent: str | None, *hints: str | None) -> dict:
    """The device columns; find gives what the first pattern of a section says."""
    out = parse_agent(agent, *hints)
    if not agent:
        return out
    for section, field in (("browser", "device_web_browser"), ("system", "device_operating_system")):
        hinted = section == "system" and (hints[1] if len(hints) > 1 else None)
        if not hinted and (found := find(section)):
            version = found["version"]
            out[field], out[f"{field}_version"] = found["name"], version and version.replace("_", ".")
    if found := find("bot"):
        return out | {"device_category": "bot", "device_mobile_brand_name": found["name"], "device_mobile_model_name": None}
    if found := find("model"):
        out["device_mobile_brand_name"] = found["brand"]
        out["device_mobile_model_name"] = (hints[0] or "").strip().strip('"') if hints and hints[0] else found["name"]
        out["device_category"] = KINDS.get(found["device"] or "", out["device_category"])
    return out


def read_database(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """A database from YAML lists of the public form: bots, browsers and systems are lists of regex, name and version; models are brands with a
    regex, a device kind and a model, or models with regexes of their own. files: section -> path, read by Spark."""
    import yaml

    rows: list[tuple] = []
    for section, path in files.items():
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        listed = yaml.safe_load(text) or []
        if section != "model":
            rows += [(section, i, e["regex"], str(e.get("name", "")), str(e["version"]) if e.get("version") else None, None, None) for i, e in enumerate(listed)]
            continue
        for brand, e in listed.items():
            for one in e.get("models") or [{"regex": e["regex"], "model": e.get("model", "")}]:
                both = one["regex"] if one["regex"] == e["regex"] else f"(?=.*(?:{e['regex']})).*?(?:{one['regex']})"
                shifted = re.compile(e["regex"]).groups if both != e["regex"] else 0
                name = re.sub(r"\$([1-9])", lambda d, n=shifted: f"${int(d[1]) + n}", str(one.get("model", "")))
                rows.append((section, len(rows), both, name, None, one.get("brand", brand), one.get("device", e.get("device"))))
    return spark.createDataFrame(rows, DATABASE)


def _header(headers: str, name: str) -> Column:
    return F.get(F.try_element_at(headers, F.lit(name)), F.lit(0))


def with_device(df: DataFrame, database: DataFrame, headers: str = "headers", most: int = MOST_PATTERNS) -> DataFrame:
    """Append the device columns by a database. A process parses an agent once, as long as it remembers it; no shuffle, unless the database has more
    than `most` patterns."""
    if database.limit(most + 1).count() > most:
        return _joined(df, database, headers)
    rows = database.orderBy("section", "place", "regex").collect()
    for r in rows:
        re.compile(r["regex"])  # a pattern that is none fails here and not in a task
    text = json.dumps([r.asDict() for r in rows])
    sent, digest = df.sparkSession.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest()

    @F.pandas_udf(", ".join(f"{c} string" for c in DEVICE))
    def parse(agents: pd.Series, model: pd.Series, system: pd.Series, version: pd.Series, mobile: pd.Series) -> pd.DataFrame:
        held, known = _loaded(digest, sent)
        out = []
        for row in zip(*(c.where(c.notna(), None).tolist() for c in (agents, model, system, version, mobile))):
            if row not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[row] = tuple(held.parse(*row).values())
            out.append(known[row])
        return pd.DataFrame(out, columns=list(DEVICE))

    made = df.withColumn("_d", parse(_header(headers, "User-Agent"), *[_header(headers, h) for h in _HINTS.values()]))
    return made.select(*df.columns, "_d.*")


#: Letters of a text that is joined, at most; of a longer one its head and its tail are.
LONGEST = 16
#: Bits of the number of a bucket in which texts are counted, and of a place in the filter before the join: what the driver holds has a fixed size.
COUNTED_BITS, FILTER_BITS = 16, 27
#: The filter has three bits for each text, whose places are taken from its key behind so many bits.
SHIFTS = (0, 18, 37)
#: A text held by more agents, or an agent with more rows, isn't left to one task.
HOT = 10_000
_SAID = ("name", "version", "brand", "device")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def windows(data: bytes) -> Iterator[np.ndarray]:
    """For each length that a joined text can have, from LEAST to LONGEST, the 64-bit keys of the windows of that length, by their start."""
    letters = np.frombuffer(data, np.uint8).astype(np.uint64)
    sums = np.zeros(len(letters), np.uint64)
    for n in range(1, min(LONGEST, len(letters)) + 1):
        sums = sums[: len(letters) - n + 1] * _BASE + letters[n - 1 :]
        if n >= LEAST:
            keys = (sums ^ (sums >> np.uint64(32))) * _MIX
            yield keys ^ (keys >> np.uint64(32))


def text_keys(texts: list[str]) -> np.ndarray:
    """The keys of texts of LEAST to LONGEST letters."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts, keys = np.cumsum(sizes + 1) - sizes - 1, np.zeros(len(texts), np.uint64)
    for n, found in enumerate(windows("\0".join(texts).encode()), LEAST):
        keys[sizes == n] = found[starts[sizes == n]]
    return keys.view(np.int64)


def keys_held(agents: list[str], bits: np.ndarray) -> list[np.ndarray]:
    """For each agent 0 and the keys of its parts that the filter lets through. A window over two agents may add a key, which does no harm."""
    some = [a.lower().encode() for a in agents]
    starts = np.cumsum([0, *(len(x) + 1 for x in some)])
    of, held = [np.arange(len(some))], [np.zeros(len(some), np.uint64)]
    for keys in windows(b"\0".join(some)):
        on = np.arange(len(keys))
        for shift in SHIFTS:
            at = (keys[on] >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
            on = on[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        of.append(np.searchsorted(starts, on, "right") - 1)
        held.append(keys[on])
    owner, keys = np.concatenate(of), np.concatenate(held)
    order = np.argsort(owner, kind="stable")
    return [np.unique(x) for x in np.split(keys[order].view(np.int64), np.searchsorted(owner[order], np.arange(1, len(some))))]


def _joined(df: DataFrame, database: DataFrame, headers: str) -> DataFrame:
    """The same for a database of any size. A pattern's key is that of its text in the emptiest of a fixed number of buckets, 0 if it has no text; distinct
    agents meet patterns by the keys of their parts. Keys and a filter of a fixed size only say what is tried. Nothing that grows with the tables
    is broadcast: sizes that Spark estimates for them are far too low, so the joins say what they are."""
    context = df.sparkSession.sparkContext
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes and much work: their number isn't to be lowered

    @F.pandas_udf("array<long>")
    def keys_of(patterns: pd.Series) -> pd.Series:
        each = [list(dict.fromkeys(x for t in sorted(needed_texts(p), key=len, reverse=True) for x in ((t,) if len(t) <= LONGEST else (t[:LONGEST], t[-LONGEST:])))) for p in patterns]
        return pd.Series(np.split(text_keys([x for texts in each for x in texts]), np.cumsum([len(texts) for texts in each])[:-1]))

    patterns = settled(database.repartition(tasks).withColumn("_keys", keys_of("regex")))
    buckets = patterns.select(F.explode("_keys").alias("key")).groupBy(F.col("key").bitwiseAND((1 << COUNTED_BITS) - 1).alias("at")).count().collect()
    counts = np.zeros(1 << COUNTED_BITS, np.int64)
    for at, n in buckets:
        counts[at] = n
    counted = context.broadcast(counts)

    @F.pandas_udf("long")
    def rarest(keys: pd.Series) -> pd.Series:
        have = counted.value
        return keys.map(lambda k: k[np.argmin(have[k & ((1 << COUNTED_BITS) - 1)])] if len(k) else 0)

    keyed = patterns.withColumn("_key", rarest("_keys")).drop("_keys")
    places = F.array(*[F.shiftrightunsigned("_key", shift).bitwiseAND((1 << FILTER_BITS) - 1) + 1 for shift in SHIFTS])
    placed = keyed.where("_key <> 0").select(F.explode(places).alias("place")).withColumn("at", F.bitmap_bucket_number("place")).repartition(tasks, "at")
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for at, own in placed.groupBy("at").agg(F.bitmap_construct_agg(F.bitmap_bit_position("place"))).collect():
        bits[(at - 1) * 4096 : at * 4096] = np.frombuffer(own, dtype=np.uint8)
    sent = context.broadcast(bits.tobytes())

    @F.pandas_udf("array<long>")
    def held(agents: pd.Series) -> pd.Series:
        have, some = np.frombuffer(sent.value, np.uint8), agents.tolist()
        return pd.Series([keys for at in range(0, len(some), 256) for keys in keys_held(some[at : at + 256], have)])

    @F.pandas_udf(", ".join(f"{c} string" for c in _SAID))
    def tried(agents: pd.Series, regexes: pd.Series, names: pd.Series, versions: pd.Series, brands: pd.Series, devices: pd.Series) -> pd.DataFrame:
        # A device of "" is none; a match is told from none by it.
        out = []
        for agent, regex, *row in zip(agents, *(c.where(c.notna(), None).tolist() for c in (regexes, names, versions, brands, devices))):
            m = _compiled(regex).search(agent)
            one = m and said(dict(zip(_SAID, row)), m)
            out.append((one["name"], one["version"], one["brand"], one["device"] or "") if one else (None,) * 4)
        return pd.DataFrame(out, columns=list(_SAID))

    given = {"_agent": _header(headers, "User-Agent")} | {f"_{h}": _header(headers, name) for h, name in _HINTS.items()}
    row = F.to_json(F.array(*given.values()))  # never null
    told = settled(df.select(row.alias("_row"), *[c.alias(name) for name, c in given.items()]).groupBy("_row", *given).agg(F.count("*").alias("_n")))
    agents = told.where("_agent <> ''").select("_agent").repartition(tasks, "_agent").distinct()
    met = settled(agents.withColumn("_keys", held("_agent"))).select("_agent", F.explode("_keys").alias("_key"))
    hot = settled(met.groupBy("_key").count().where((F.col("count") > HOT) | (F.col("_key") == 0)).select("_key", F.lit(True).alias("_hot")))
    shares = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0)))  # the patterns of a hot key go to all tasks, its agents are dealt
    share = F.when(F.col("_hot"), F.pmod(F.xxhash64("_agent"), F.lit(tasks)).cast("int")).otherwise(0)
    left = met.join(F.broadcast(hot), "_key", "left").select("_key", "_agent", share.alias("_share")).repartition(tasks, "_key", "_share")
    right = keyed.join(F.broadcast(hot), "_key", "left").withColumn("_share", F.explode(shares)).drop("_hot").repartition(tasks, "_key", "_share")
    pairs = left.join(right.hint("merge"), ["_key", "_share"]).sortWithinPartitions("regex")  # a pattern is compiled once in a task
    judged = pairs.withColumn("_said", tried("_agent", "regex", *_SAID)).where("_said.device is not null")
    sections, size = ("bot", "browser", "system", "model"), len(given)
    first = judged.groupBy("_agent").agg(*[F.min_by(F.when(F.col("section") == s, F.col("_said")), F.when(F.col("section") == s, F.struct("place", "regex"))).alias(f"_{s}_said") for s in sections])

    @F.pandas_udf(", ".join(f"{c} string" for c in DEVICE))
    def describe(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for values in zip(*(c.where(c.notna(), None).tolist() for c in columns)):
            of, says = values[:size], iter(values[size:])
            found = {s: dict(zip(_SAID, four)) for s, four in zip(sections, zip(*[says] * len(_SAID))) if four[-1] is not None}
            out.append(tuple(described(found.get, *of).values()))
        return pd.DataFrame(out, columns=list(DEVICE))

    both = told.join(first.hint("merge"), "_agent", "left").repartition(tasks, "_row")
    each = settled(both.select("_row", "_n", describe(*given, *[f"_{s}_said.{c}" for s in sections for c in _SAID]).alias("_d")))
    if each.limit(HOT + 1).count() <= HOT:
        return df.withColumn("_row", row).join(F.broadcast(each), "_row", "left").select(*df.columns, "_d.*")
    often = F.broadcast(each.where(F.col("_n") > HOT).select("_row", F.col("_d").alias("_often")))
    dealt = F.concat(F.lit("#"), F.xxhash64(F.lit(0), *[c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]).cast("string"))  # no row's text
    made = df.withColumn("_row", row).join(often, "_row", "left").withColumn("_at", F.when(F.col("_often").isNull(), F.col("_row")).otherwise(dealt))
    made = made.join(each.select(F.col("_row").alias("_at"), "_d").hint("merge"), "_at", "left")
    return made.select(*df.columns, *[F.coalesce(f"_often.{c}", f"_d.{c}").alias(c) for c in DEVICE])


@lru_cache(maxsize=4096)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex, re.I)


_LOADED: dict[str, tuple[Database, dict]] = {}


def _loaded(digest: str, sent) -> tuple[Database, dict]:
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = (Database(json.loads(sent.value)), {})
    return _LOADED[digest]
