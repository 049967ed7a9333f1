"""Source, medium and term of a session's traffic: one CASE chain over its first event, and lookups of referrer hosts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from .lookups import small

#: Click ids of a page address, in order: parameter, source, medium (fixed values).
CLICK_IDS = [
    ("gclid", "google", "cpc"), ("gbraid", "google", "cpc"), ("wbraid", "google", "cpc"), ("msclkid", "bing", "cpc"), ("fbclid", "facebook", "cpc"),
    ("twclid", "twitter", "cpc"), ("li_fat_id", "linkedin", "cpc"), ("ttclid", "tiktok", "cpc"), ("ScCid", "snapchat", "cpc"), ("irclickid", "impact", "affiliate"),
]
CLICK_SOURCES = [("aw.ds", "google", "cpc"), ("3p.ds", "google", "display")]

#: A short referrer list of our own: host, kind, name, term parameters. A deployment loads its own table of this shape (read_referrers).
REFERRERS = [
    ("youtube.com", "video", "youtube", ""), ("vimeo.com", "video", "vimeo", ""), ("twitch.tv", "video", "twitch", ""),
    ("dailymotion.com", "video", "dailymotion", ""), ("bilibili.com", "video", "bilibili", ""), ("rutube.ru", "video", "rutube", ""), ("youtu.be", "video", "youtube", ""),
    ("mail.google.com", "email", "gmail", ""), ("outlook.live.com", "email", "outlook", ""), ("mail.yahoo.com", "email", "yahoo mail", ""),
    ("mail.proton.me", "email", "proton mail", ""), ("mail.yandex.{}", "email", "yandex mail", ""), ("mail.ru", "email", "mail.ru", ""), ("fastmail.com", "email", "fastmail", ""), ("mail.zoho.com", "email", "zoho mail", ""),
    ("medium.com", "referral", "medium", ""), ("substack.com", "referral", "substack", ""), ("news.ycombinator.com", "referral", "hacker news", ""), ("producthunt.com", "referral", "product hunt", ""), ("github.com", "referral", "github", ""),
    ("facebook.com", "social", "facebook", ""), ("instagram.com", "social", "instagram", ""), ("t.co", "social", "twitter", ""), ("x.com", "social", "twitter", ""),
    ("linkedin.com", "social", "linkedin", ""), ("reddit.com", "social", "reddit", ""), ("pinterest.com", "social", "pinterest", ""),
    ("threads.net", "social", "threads", ""), ("bsky.app", "social", "bluesky", ""), ("vk.com", "social", "vk", ""), ("tumblr.com", "social", "tumblr", ""), ("quora.com", "social", "quora", ""), ("snapchat.com", "social", "snapchat", ""),
    ("chatgpt.com", "ai", "chatgpt", ""), ("perplexity.ai", "ai", "perplexity", ""), ("claude.ai", "ai", "claude", ""), ("gemini.google.com", "ai", "gemini", ""),
    ("copilot.microsoft.com", "ai", "copilot", ""), ("chat.deepseek.com", "ai", "deepseek", ""), ("chat.mistral.ai", "ai", "mistral", ""), ("you.com", "ai", "you.com", ""), ("poe.com", "ai", "poe", ""),
    ("naver.com", "search", "naver", "query"), ("search.brave.com", "search", "brave", "q"), ("startpage.com", "search", "startpage", "query"), ("qwant.com", "search", "qwant", "q"), ("seznam.cz", "search", "seznam", "q"), ("sogou.com", "search", "sogou", "query"),
    ("google.{}", "search", "google", "q"), ("bing.com", "search", "bing", "q"), ("duckduckgo.com", "search", "duckduckgo", "q"), ("yahoo.{}", "search", "yahoo", "p"),
    ("search.yahoo.com", "search", "yahoo", "p"), ("yandex.{}", "search", "yandex", "text"), ("baidu.com", "search", "baidu", "wd,word"), ("ecosia.org", "search", "ecosia", "q"),
]
#: Kinds in the order in which they decide; `mail.` in the raw referrer comes between referral and social.
KINDS = ("video", "email", "referral", "mail", "social", "ai", "search")


def referrer_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """pattern, kind, name, terms; a pattern is a host, or has {} for one label or more."""
    return spark.createDataFrame(rows or REFERRERS, "pattern string, kind string, name string, terms string")


def suffixes(host: Column) -> Column:
    """a.b.c -> a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


#: Patterns up to which a referrer table is sent with the plan, as one constant; a larger one is joined by host.
CONSTANT_PATTERNS = 500
_ENTRY = "struct<length:int,kind:string,name:string,terms:string>"


def read_referrers(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """A referrer table from YAML lists of the public form (kind -> file): a name with hosts, or with groups of urls and params."""
    import yaml

    rows = []
    for kind, file in files.items():
        with open(file, encoding="utf-8") as text:
            for name, groups in (yaml.safe_load(text) or {}).items():
                for g in groups or ():
                    urls_of, terms = (g.get("urls", ()), g.get("params", ())) if isinstance(g, dict) else ((g,), ())
                    rows += [(str(u), kind, str(name), ",".join(t for t in terms if not str(t).startswith("/"))) for u in urls_of]
    return referrer_table(spark, rows)


def plain_pattern(pattern: Column) -> Column:
    return F.regexp_replace(F.lower(pattern), r"^(www\.)?(\{\}\.)?", "")


def constant_table(table: DataFrame) -> Column | None:
    """The table as a map of pattern -> entries, folded to one constant when the plan is optimised; None if it has too many patterns for that."""
    rows = table.select(plain_pattern(F.col("pattern")).alias("pattern"), "kind", "name", "terms").limit(CONSTANT_PATTERNS + 1).collect()
    if len(rows) > CONSTANT_PATTERNS:
        return None
    held: dict[str, list] = {}
    for r in rows:
        held.setdefault(r["pattern"], []).append({"length": -len(r["pattern"]), "kind": r["kind"], "name": r["name"], "terms": r["terms"] or ""})
    return F.from_json(F.lit(json.dumps(held)), f"map<string,array<{_ENTRY}>>")


def keys_of(host: Column) -> Column:
    """What a pattern must equal to hold for a host: its suffixes at dots, and those with {} for their last label or last two."""
    labels = lambda t: F.split(t, r"\.")
    wild = lambda t, n: F.when(F.size(labels(t)) > n, F.concat(F.array_join(F.slice(labels(t), F.lit(1), F.greatest(F.size(labels(t)) - n, F.lit(1))), "."), F.lit(".{}")))
    return F.array_compact(F.flatten(F.transform(suffixes(host), lambda t: F.array(t, wild(t, 1), wild(t, 2)))))


_FOUND = [k for k in KINDS if k != "mail"]


def found_kinds(host: Column, known: Column) -> Column:
    """map of kind -> entry for a host without www, of a constant table. The longest pattern wins within a kind, then the name.

    A pattern is a host or a suffix of one at a dot; a {} in it stands for one label or two at its end.
    """
    hits = F.flatten(F.array_compact(F.transform(keys_of(host), lambda k: F.try_element_at(known, k))))

    def best(held: Column, kind: str) -> Column:
        return F.get(F.array_sort(F.filter(held, lambda e: e["kind"] == kind)), F.lit(0))

    return urls.let(hits, lambda held: F.map_from_arrays(F.array(*map(F.lit, _FOUND)), F.array(*[best(held, k) for k in _FOUND])))


def found_hosts(hosts: DataFrame, table: DataFrame) -> DataFrame:
    """_host and found (as found_kinds has it) of the hosts of the column _host for which a pattern of the table holds: an equi-join of the
    hosts' suffixes with the patterns, which are broadcast if they were counted to be few."""
    asked = hosts.where("_host <> ''").select("_host").distinct().select("_host", F.explode(keys_of(F.col("_host"))).alias("_key"))
    pattern = plain_pattern(F.col("pattern"))
    entries = table.select(pattern.alias("_key"), F.struct((-F.length(pattern)).alias("length"), "kind", "name", F.coalesce("terms", F.lit("")).alias("terms")).alias("_entry"))
    hits = asked.join(small(entries), "_key")
    best = [F.min(F.when(F.col("_entry.kind") == k, F.col("_entry"))) for k in _FOUND]
    return hits.groupBy("_host").agg(F.map_from_arrays(F.array(*map(F.lit, _FOUND)), F.array(*best)).alias("found"))


def attribute(df: DataFrame, table: DataFrame, page: str = "original_page_location", referrer: str = "page_referrer", ignore: str = "ignore_referrer", utm: dict[str, str] | None = None, first: Column | None = None, referrers: DataFrame | None = None) -> DataFrame:
    """Append session_source, session_medium, session_term to rows of first events.

    first: if given, rows on which it is false get nulls and cost nothing. referrers: where the referrer column can be read at less cost than
    from df; it is read once more for a table of more than CONSTANT_PATTERNS patterns.

    Click ids of the page address, then referrer lists by kind, then a foreign referrer host, then direct; UTM values of the
    page's columns override field by field; labels are normalised.
    """
    utm = utm or {"source": "utm_source", "medium": "utm_medium", "term": "utm_term"}
    on = F.lit(True) if first is None else first
    raw = F.when(F.coalesce(F.col(ignore), F.lit(False)), F.lit("")).otherwise(F.coalesce(F.col(referrer), F.lit("")))
    df = df.withColumn("_on", on).withColumn("_ref", F.when(F.col("_on"), raw).otherwise(F.lit("")))
    df = df.withColumn("_ref_host", urls.without_www(urls.host(F.col("_ref")))).withColumn("_page_host", urls.without_www(urls.host(F.coalesce(F.col(page), F.lit("")))))
    known = constant_table(table)
    if known is not None:
        df = df.withColumn("found", F.when(F.col("_ref_host") != "", found_kinds(F.col("_ref_host"), known)))
    else:
        asked = (df if referrers is None else referrers).select(urls.without_www(urls.host(F.coalesce(F.col(referrer), F.lit("")))).alias("_host"))
        df = df.join(small(found_hosts(asked, table)), F.col("_ref_host") == F.col("_host"), "left").drop("_host")
    df = df.withColumn("_pq", F.when(F.col("_on") & F.contains(F.col(page), F.lit("?")), urls.parse_query(urls.query(F.col(page)))))
    has = lambda name: F.coalesce(urls.first_value(F.col("_pq"), name) != "", F.lit(False))
    out = lambda s, m, t=None: F.struct(s.alias("source"), F.lit(m).alias("medium"), (F.lit(None).cast("string") if t is None else t).alias("term"))
    rule = None
    for name, source, medium in CLICK_IDS:
        rule = (F if rule is None else rule).when(has(name), out(F.lit(source), medium))
    for value, source, medium in CLICK_SOURCES:
        rule = rule.when(F.coalesce(urls.first_value(F.col("_pq"), "gclsrc") == value, F.lit(False)), out(F.lit(source), medium))
    found = lambda kind: F.try_element_at("found", F.lit(kind))
    for kind in KINDS:
        if kind == "mail":
            rule = rule.when(F.contains(F.col("_ref"), F.lit("mail.")), out(F.regexp_replace("_ref_host", r"^(www|email)\.", ""), "email"))
        elif kind == "search":
            terms = urls.let(urls.parse_query(urls.query(F.col("_ref"))), lambda q: F.filter(F.transform(F.split(found("search")["terms"], ","), lambda t: F.get(F.try_element_at(q, t), F.lit(0))), lambda v: v != ""))
            rule = rule.when(found(kind).isNotNull(), out(F.lower(found(kind)["name"]), "organic", F.get(terms, F.lit(0))))
        else:
            rule = rule.when(found(kind).isNotNull(), out(found(kind)["name"], kind))
    foreign = (F.col("_ref_host") != "") & (F.col("_page_host") != "") & (F.col("_ref_host") != F.col("_page_host"))
    rule = rule.when(foreign, out(F.col("_ref_host"), "referral")).otherwise(out(F.lit("direct"), "none"))
    df = df.withColumn("_smt", F.when(F.col("_on"), rule))
    for field, column in utm.items():
        value = F.nullif(F.col(column), F.lit("")) if column in df.columns else F.lit(None).cast("string")
        df = df.withColumn(f"session_{field}", F.when(F.col("_on"), urls.normalize_label(F.coalesce(value, F.col("_smt")[field]))))
    return df.drop("_on", "_ref", "_ref_host", "_page_host", "found", "_smt", "_pq")
