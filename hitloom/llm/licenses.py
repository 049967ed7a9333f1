"""License scans: fuzzy search for short license notices.

A notice may be found with up to k edits. Cut into k + 1 seeds, at least one seed must then stand unchanged
(pigeonhole). One Aho-Corasick pass finds all seeds; around each, the regex library's bounded-error matching
verifies the edits and gives the span. Works on words: A-Z lower-cased, cut at ASCII non-alphanumerics,
joined by single blanks.

A match begins and ends with whole words, and the notice's words of up to EXACT letters, which name the license ("mit", "cc by",
"gnu"), stand in it unchanged. Matches of one notice don't overlap and are found from left to right, so every stretch of
words within the notice's edits overlaps a reported match of it.

Null and empty texts have no words, no labels, score 0. Every row gets exactly one result row, repeated ones too; texts are scanned whole.
All other columns pass through; one that has a name of the result's is replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

#: Fixed values of the contract: phrase and label, found exactly.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices found with edits, one label each.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version", "apache"),
    ("licensed under the general public license version", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under the mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("all rights reserved", "reserved"),
]
#: Letters for each allowed edit, and the longest words of a notice that must stand unchanged.
LETTERS_AN_EDIT, EXACT = 9, 3

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Scanner:
    def __init__(self, base: dict[str, str], notices: list[tuple[str, str]]):
        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.notices, self.finder = [], ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, label) in enumerate(notices):
            edits = max(1, len(notice) // LETTERS_AN_EDIT)
            pattern = regex.compile(b"(?e)(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(notice.encode(), special_only=True), edits))
            self.notices.append((pattern, label, len(notice), edits, Counter(w for w in notice.encode().split() if len(w) <= EXACT)))
            cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[a:b], []).append((k, a))
        for seed, uses in seeds.items():
            self.finder.add_word(seed, (len(seed), uses))
        self.finder.make_automaton()

    def __call__(self, text: str | None) -> tuple:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        places, first, last, base_labels = 0, None, None, set()
        number = lambda at: joined.count(b" ", 0, at + 1) - 1  # noqa: E731  of the word that starts after the blank at `at`
        for phrase, label in self.base:
            at = joined.find(phrase)
            if at < 0:
                continue
            lowest, highest = number(at), at
            while at >= 0:
                places, highest = places + 1, at
                at = joined.find(phrase, at + 1)
            base_labels.add(label)
            highest = number(highest)
            first = lowest if first is None else min(first, lowest)
            last = highest if last is None else max(last, highest)
        matches = self.fuzzy(joined)
        labels = base_labels | {m["label"] for m in matches}
        score = 1.0 if base_labels else max((1.0 - m["edits"] / (m["end"] - m["start"] + m["edits"] + 1) for m in matches), default=0.0)
        return len(words), places, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, matches

    def fuzzy(self, joined: bytes) -> list[dict]:
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, (size, uses) in self.finder.iter(joined.decode("latin-1")):
            for k, at in uses:
                _, _, length, edits, _ = self.notices[k]
                start = end + 1 - size - at  # of the notice, if nothing before the seed was edited
                windows.setdefault(k, set()).add((max(0, start - edits - 1), min(len(joined), start + length + 2 * edits + 1)))
        found = []
        for k, spans in windows.items():
            pattern, label, _, _, exact = self.notices[k]
            merged: list[list[int]] = []
            for low, high in sorted(spans):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            at, first = 0, -1  # the blanks before `at`, less one, are the word's number
            for low, high in merged:
                while hit := pattern.search(joined, low, high):
                    if exact - Counter(hit[0].split()):
                        low = hit.start() + 1
                        continue
                    first, at = first + joined.count(b" ", at, hit.start()), hit.start()
                    found.append({"label": label, "start": first, "end": first + hit[0].count(b" "), "edits": sum(hit.fuzzy_counts)})
                    low = hit.end()
        return sorted(found, key=lambda m: (m["start"], m["label"]))


OUT = {
    "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double",
    "matches": "array<struct<label:string,start:int,end:int,edits:int>>",
}


def scan_licenses(df: DataFrame, text: str = "text", base: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """Append the columns of OUT; start and end in matches are numbers of the first and the last word of a fuzzy match."""
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices

    def factory():
        scan = Scanner(base, notices)
        return lambda texts: list(zip(*map(scan, texts))) if texts else [[]] * len(OUT)

    return map_rows(df, [text], OUT, factory)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {"op2_license_scan": op2_license_scan}
