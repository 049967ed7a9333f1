"""Lookups: property settings, currencies, address ranges, devices."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.addresses import V4_PREFIX, ip_key
from ..functions.casts import bankers_round

#: A lookup table is broadcast up to so many rows, which are counted first; beyond that Spark joins by shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Snapshots:
    """A lookup table in versions: <path>/version=<number>, each written whole by Spark (so it ends with _SUCCESS).

    Called, it gives the newest finished version, through `build` if that is given. Where it stands for a table in a stream
    (streaming.sessions.write_wide), each micro-batch asks anew, so a version that is added counts from the next batch on.
    """

    def __init__(self, spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet"):
        self.spark, self.path, self.build, self.format = spark, path.rstrip("/"), build, fmt

    def versions(self) -> list[int]:
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        found = at.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def __call__(self) -> DataFrame:
        known = self.versions()
        if not known:
            raise ValueError(f"{self.path} has no finished version")
        table = self.spark.read.format(self.format).load(f"{self.path}/version={known[-1]}")
        return self.build(table) if self.build else table


def with_property(hits: DataFrame, settings: DataFrame, default: bool = False, key: str = "property_id") -> DataFrame:
    """property_name and the settings of each hit's property, by its id or another key; hits of unknown properties go (or keep nulls, with default)."""
    return hits.join(small(settings), key, "left" if default else "inner")


def latest_rates(snapshots: DataFrame) -> DataFrame:
    """base, quote, rate of the newest snapshot (created_at, rates: map of base to map of quote to rate)."""
    valid = snapshots.where(F.col("created_at").isNotNull() & (F.size("rates") > 0))
    newest = valid.orderBy(F.desc("created_at")).limit(1)
    return newest.select(F.explode("rates").alias("base", "quotes")).select(F.lower(F.trim("base")).alias("base"), F.explode("quotes").alias("quote", "rate")).withColumn("quote", F.lower(F.trim("quote")))


def convert(df: DataFrame, rates: DataFrame, value: str, currency: str, to: str, out: str) -> DataFrame:
    """out = value in currency `to`: unrounded for the same currency, else rounded half to even; unknown pairs give null."""
    r = rates.where(F.col("quote") == to.lower()).select(F.col("base").alias("_base"), F.col("rate").alias("_rate"))
    key = F.lower(F.trim(F.col(currency)))
    joined = df.join(small(r), key == F.col("_base"), "left")
    amount = F.when(key == to.lower(), F.col(value)).otherwise(bankers_round(F.col(value) * F.col("_rate")))
    return joined.withColumn(out, F.when(F.col(value).isNotNull() & F.col(currency).isNotNull(), amount)).drop("_base", "_rate")


def ip_ranges(df: DataFrame, ranges: DataFrame, ip: str = "ip_address") -> DataFrame:
    """Append a range's columns to rows whose address it holds; the narrowest range wins. lo and hi: numbers of IPv4 addresses, or texts of
    addresses of either family; other columns are the range's values.

    Ranges are cut at the borders of networks (IPv4: /16, IPv6: /24), so that the join is an equi-join with a comparison left
    over. Where no two ranges overlap, which is found out from the ranges, each row meets one range at most and the join is
    all; else the distinct addresses are joined, and the narrowest range of each.
    """
    numbers = dict(ranges.dtypes)["lo"] != "string"
    end = lambda c: F.concat(F.lit(V4_PREFIX), F.lpad(F.lower(F.hex(F.col(c).cast("bigint"))), 8, "0")) if numbers else ip_key(F.col(c))
    digits = lambda k: F.when(k.startswith(V4_PREFIX), F.lit(28)).otherwise(F.lit(6))
    head = lambda k: F.substring(k, F.lit(1), digits(k))
    values = [c for c in ranges.columns if c not in ("lo", "hi")]
    span = ranges.withColumns({"_lo": end("lo"), "_hi": end("hi")}).where("_lo <= _hi")
    part = lambda c: F.conv(F.when(F.col("_lo").startswith(V4_PREFIX), F.substring(c, 25, 4)).otherwise(F.substring(c, 1, 6)), 16, 10).cast("bigint")
    cut = F.when(F.col("_lo").startswith(V4_PREFIX), F.concat(F.lit(V4_PREFIX), F.lpad(F.lower(F.hex("_at")), 4, "0"))).otherwise(F.lpad(F.lower(F.hex("_at")), 6, "0"))
    span = span.withColumn("_at", F.explode(F.sequence(part("_lo"), part("_hi")))).select(cut.alias("_b"), "_lo", "_hi", *values)
    before = Window.partitionBy("_b").orderBy("_lo", "_hi").rowsBetween(Window.unboundedPreceding, -1)
    overlapping = not span.select((F.max("_hi").over(before) >= F.col("_lo")).alias("o")).where("o").isEmpty()
    left = df.withColumn("_k", ip_key(F.col(ip)))
    if not overlapping:
        span = small(span).withColumnsRenamed({v: f"_v_{v}" for v in values})
        joined = left.withColumn("_a", head(F.col("_k"))).join(span, (F.col("_a") == F.col("_b")) & F.col("_k").between(F.col("_lo"), F.col("_hi")), "left")
        return joined.select(*df.columns, *[F.col(f"_v_{v}").alias(v) for v in values])
    addresses = left.select("_k").where("_k is not null").distinct().withColumn("_b", head(F.col("_k")))
    hits = addresses.join(small(span), "_b").where(F.col("_k").between(F.col("_lo"), F.col("_hi")))
    width = F.struct(*[(F.conv(F.substring("_hi", i, 8), 16, 10).cast("bigint") - F.conv(F.substring("_lo", i, 8), 16, 10).cast("bigint")).alias(f"w{i}") for i in (1, 9, 17, 25)])
    best = hits.groupBy("_k").agg(F.min(F.struct(width.alias("w"), "_lo", *values)).alias("_r"))
    return left.join(best, "_k", "left").select(*df.columns, *[F.col(f"_r.{v}").alias(v) for v in values])


#: Patterns of our own, the first that fits decides; a deployment may pass its own parser. Names are the public ones of browsers and systems.
_BROWSERS = [
    ("Facebook", r"FBAV/([\d.]+)"), ("Instagram App", r"Instagram ([\d.]+)"), ("Microsoft Edge", r"Edg(?:e|A|iOS)?/([\d.]+)"), ("Opera Mini", r"Opera Mini/([\d.]+)"), ("Opera GX", r"OPX/([\d.]+)"),
    ("Opera", r"(?:OPR|OPT|Opera)[/ ]([\d.]+)"), ("Samsung Browser", r"SamsungBrowser/([\d.]+)"), ("Yandex Browser", r"YaBrowser/([\d.]+)"), ("Vivaldi", r"Vivaldi/([\d.]+)"), ("UC Browser", r"UC ?Browser/([\d.]+)"),
    ("MIUI Browser", r"MiuiBrowser/([\d.]+)"), ("Huawei Browser", r"HuaweiBrowser/([\d.]+)"), ("DuckDuckGo Privacy Browser", r"(?:DuckDuckGo|Ddg)/([\d.]+)"), ("Mobile Silk", r"Silk/([\d.]+)"), ("Brave", r"Brave/([\d.]+)"),
    ("Firefox Focus", r"(?:Focus|Klar)/([\d.]+)"), ("Firefox Mobile iOS", r"FxiOS/([\d.]+)"), ("Firefox Mobile", r"(?:Mobile|Tablet); rv.*Firefox/([\d.]+)"), ("Firefox", r"Firefox/([\d.]+)"), ("Internet Explorer", r"(?:MSIE |Trident/.*rv:)([\d.]+)"),
    ("Google Search App", r"GSA/([\d.]+)"), ("Chrome Mobile iOS", r"CriOS/([\d.]+)"), ("Headless Chrome", r"HeadlessChrome/([\d.]+)"), ("Chrome Webview", r"; wv\).*Chrome/([\d.]+)"), ("Chrome Mobile", r"Android.*Chrome/([\d.]+)"), ("Chrome", r"Chrom(?:e|ium)/([\d.]+)"),
    ("Android Browser", r"Android.*Version/([\d.]+)"), ("Mobile Safari", r"(?:iPhone|iPad|iPod).*Version/([\d.]+).*Safari/"), ("Safari", r"Version/([\d.]+).*Safari/"),
]
_SYSTEMS = [
    ("Windows Phone", r"Windows Phone(?: OS)? ([\d.]+)"), ("iPadOS", r"iPad.*? OS (1[3-9][\d_]*|[2-9]\d[\d_]*)"), ("iOS", r"(?:iPhone|iPad|iPod).*? OS ([\d_]+)"), ("HarmonyOS", r"HarmonyOS[/ ]?([\d.]*)"), ("KaiOS", r"KAIOS/([\d.]+)"),
    ("Fire OS", r"Android ([\d.]+).*(?:KF[A-Z]{2,}|Silk)"), ("Android TV", r"Android ([\d.]+).*(?:TV|BRAVIA)"), ("Android", r"Android ?([\d.]*)"), ("Tizen", r"Tizen ([\d.]+)"), ("webOS", r"Web0?S"), ("Windows", r"Windows NT ([\d.]+)"), ("Windows", r"Windows"),
    ("Mac", r"Mac OS X ([\d_.]+)"), ("Mac", r"Macintosh"), ("Chrome OS", r"CrOS \S+ ([\d.]+)"), ("Ubuntu", r"Ubuntu(?:/([\d.]+))?"), ("Fedora", r"Fedora(?:/([\d.]+))?"), ("GNU/Linux", r"Linux|X11"),
]
#: Versions of Windows by kernel (fixed values).
_WINDOWS = {"10.0": "10", "6.3": "8.1", "6.2": "8", "6.1": "7", "6.0": "Vista", "5.2": "XP", "5.1": "XP"}
_BRANDS = [
    ("Samsung", r"SM-|SAMSUNG|GT-[A-Z]\d"), ("Google", r"Pixel|Nexus"), ("Xiaomi", r"Redmi|POCO|\bMi |M20\d\d|2\d{7,9}[A-Z]"), ("Huawei", r"HUAWEI|Huawei|[A-Z]{3}-(?:L|AL|TL|LX)\d+"), ("OnePlus", r"ONEPLUS|OnePlus"), ("OPPO", r"OPPO|CPH\d{4}"), ("Vivo", r"\bvivo|V\d{4}[A-Z]?"),
    ("Motorola", r"moto|Moto|motorola|XT\d{4}"), ("LG", r"LG-|LM-"), ("Sony", r"Xperia|Sony|SO-\d|XQ-"), ("Nokia", r"Nokia|TA-\d{4}"), ("Realme", r"RMX\d{4}|realme"), ("Asus", r"ASUS|ZenFone"), ("Lenovo", r"Lenovo"), ("HTC", r"HTC"), ("ZTE", r"ZTE"), ("Honor", r"HONOR|Honor"), ("Amazon", r"\bKF[A-Z]{2,}"),
]
_BOT = re.compile(r"([\w.-]*(?:bot|crawler|spider|slurp|preview|monitor|scraper)[\w.-]*)|HeadlessChrome|Lighthouse|curl/|wget/|python-requests|Go-http-client|facebookexternalhit", re.I)
_TV = re.compile(r"SMART-TV|SmartTV|HbbTV|AppleTV|BRAVIA|Android TV|GoogleTV|Roku|NetCast|Web0S", re.I)
_CONSOLE = re.compile(r"PlayStation|Xbox|Nintendo")
_MODEL = re.compile(r"Android[ \d.]*; (?:[a-z]{2}[-_][A-Za-z]{2}; )?([^;)]+?)(?: Build|\))")
DEVICE = ("device_category", "device_mobile_brand_name", "device_mobile_model_name", "device_operating_system", "device_operating_system_version", "device_web_browser", "device_web_browser_version")
_HINTS = {"model": "Sec-Ch-Ua-Model", "system": "Sec-Ch-Ua-Platform", "version": "Sec-Ch-Ua-Platform-Version", "mobile": "Sec-Ch-Ua-Mobile"}


def parse_agent(agent: str | None, model: str | None = None, system: str | None = None, version: str | None = None, mobile: str | None = None) -> dict:
    """Device columns of a user agent and its client hints, which come first where they say something."""
    out = dict.fromkeys(DEVICE)
    if not agent:
        return out
    for field, table in (("device_web_browser", _BROWSERS), ("device_operating_system", _SYSTEMS)):
        for name, pattern in table:
            if m := re.search(pattern, agent):
                found = next((g for g in m.groups() if g), None)
                out[field], out[f"{field}_version"] = name, found and found.replace("_", ".")
                break
    if out["device_operating_system"] == "Windows":
        out["device_operating_system_version"] = _WINDOWS.get(out["device_operating_system_version"], out["device_operating_system_version"])
    hint = lambda v: (v or "").strip().strip('"')
    if hint(system):
        out["device_operating_system"] = {"macOS": "Mac", "Linux": "GNU/Linux", "Chromium OS": "Chrome OS"}.get(hint(system), hint(system))
        out["device_operating_system_version"] = hint(version) or out["device_operating_system_version"]
    tablet = "iPad" in agent or "Tablet" in agent or ("Android" in agent and "Mobile" not in agent)
    phone = "iPhone" in agent or "iPod" in agent or "Windows Phone" in agent or "Mobile" in agent or hint(mobile) == "?1"
    bot = _BOT.search(agent)
    kinds = ((bot, "bot"), (_TV.search(agent), "tv"), (_CONSOLE.search(agent), "console"), (tablet, "tablet"), (phone, "smartphone"))
    out["device_category"] = next((kind for on, kind in kinds if on), "desktop")
    if bot:
        out["device_mobile_brand_name"] = bot[1]
    elif m := re.search("iPhone|iPad|iPod", agent):
        out["device_mobile_brand_name"], out["device_mobile_model_name"] = "Apple", m[0]
    else:
        m = _MODEL.search(agent)
        found = hint(model) or (m[1] if m and m[1] not in ("K", "wv") and not m[1].startswith("rv:") else None)
        out["device_mobile_model_name"] = found
        out["device_mobile_brand_name"] = next((name for name, pattern in _BRANDS if found and re.search(pattern, found)), None)
    return out


@lru_cache(maxsize=100_000)
def _parsed(agent: str | None, *hints: str | None) -> tuple:
    return tuple(parse_agent(agent, *hints).values())


def with_device(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Append the device columns. An agent is parsed once in each Python process (bounded memory of the latest ones); no shuffle."""

    @F.pandas_udf(", ".join(f"{c} string" for c in DEVICE))
    def parse(agents: pd.Series, model: pd.Series, system: pd.Series, version: pd.Series, mobile: pd.Series) -> pd.DataFrame:
        rows = [_parsed(*(None if x is None or x != x else x for x in row)) for row in zip(agents, model, system, version, mobile)]
        return pd.DataFrame(rows, columns=list(DEVICE))

    header = lambda name: F.get(F.try_element_at(headers, F.lit(name)), F.lit(0))
    made = df.withColumn("_d", parse(header("User-Agent"), *map(header, _HINTS.values())))
    return made.select(*df.columns, "_d.*")


def nested_lookup(array: Column, match_field: str, match_equals: str, value_field: str, cast: str = "string") -> Column:
    """The last non-null value of the structs whose match_field equals a literal; the basis of custom columns."""
    rows = F.filter(array, lambda r: (r[match_field].cast("string") == match_equals) & r[value_field].isNotNull())
    return F.try_element_at(rows, F.lit(-1))[value_field].try_cast(cast)
