"""Substring dedup, source divergence and filter audit against plain models."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from compare import differences
from hitloom.llm import filter_audit, repeats, source_audit

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, at string, n long, `set` string, flags string"


def prose(seed, n, words=300):
    rng = random.Random(seed)
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def frame(spark, rows):
    """rows of (doc_id, text, lang, source), with columns that clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], DOCS).repartition(3)


def last(i):
    return (1 << 63) - 1 if i is None else i


def removal_model(rows):
    words, least = [repeats.words_of(t) for _, t in rows], {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, 1 << 63), last(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < last(i):
                gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone) if not y)).hexdigest()))
    return Counter(out)


def passages():
    """Documents that share passages of 10 to 40 words at all offsets, within and across; copies, repeats, odd ids and texts."""
    rng, shared = random.Random(41), [prose(1000 + i, 10 + i) for i in range(31)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += prose(rng.random(), rng.randrange(30)) + rng.choice(shared)[rng.randrange(4) :]
        rows.append((rng.choice([i, i, i, 7, None]), " \n".join(w) if i % 2 else " ".join(w)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (None, rows[0][1]), rows[5], rows[5], (300, None), (301, ""), (None, None), (302, "one two")]
    rows += [(310, " ".join(shared[30][:13])), (311, " ".join(shared[30][:12])), (-5, " ".join(shared[30]))]
    own = " ".join(prose(77, 20))
    rows += [(400, f"{own} x {own}"), (401, f"a\x1cb {own.upper()} {own.upper()}"), (402, " ".join(prose(5, 20_000)) + " " + own), (403, "日本 é " + own)]
    return rows


def test_substring_dedup_against_all_windows(spark):
    rows = passages()
    found = repeats.substring_dedup(frame(spark, [(*r, "en", "s") for r in rows])).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removal_model(rows)
    removed = sum(r["n_removed"] for r in found)
    assert removed > 1000 and len({r["n_removed"] for r in found}) > 20
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    for r in found:
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) and all(s["end"] - s["start"] >= 13 for s in r["spans"])
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))  # spans are maximal
        assert r["kept_sha256"] in {hashlib.sha256(repeats.kept_text(t, r["spans"]).encode()).hexdigest() for t in texts[r["doc_id"]]}
    assert repeats.substring_dedup(frame(spark, [(1, "x", "en", "s")]).limit(0)).count() == 0


def test_substring_dedup_over_many_batches(spark, monkeypatch):
    """Batches of a few documents, as tasks of their own see them, and few bits of hashes."""
    monkeypatch.setattr(repeats, "BIN_WORDS", 64)
    monkeypatch.setattr(repeats, "FILTER_BITS", 64)
    rows = [r for r in passages() if len(r[1] or "") < 10_000]
    found = repeats.substring_dedup(frame(spark, [(*r, None, None) for r in rows]), batch_docs=4).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removal_model(rows)


def test_every_window_meets_its_block_within_a_batch_and_across():
    import numpy as np
    import xxhash

    code = lambda w: np.array([xxhash.xxh3_64_intdigest(x) for x in map(str.encode, w)], dtype=np.uint64)
    common = prose(3, 13)
    for shift in range(7):
        a, b = code(prose(4, 5 + shift) + common + prose(5, 9)), code(prose(6, 11) + common + prose(7, 4))
        one, two = (repeats.Batch(np.array([i]), np.array([i]), [w]) for i, w in enumerate((a, b)))
        rows = [(k, n, h, ids, at) for n, batch in enumerate((one, two)) for _, k, h, ids, at in repeats.anchors(batch, 0)[0]]
        got = defaultdict(set)
        for n, at in repeats.answer_anchors(iter(sorted(rows, key=lambda r: r[0]))):
            got[n] |= set(at.tolist())
        for n, start in ((0, 5 + shift), (1, 11)):  # a hit within the window on both sides
            assert any(start <= x <= start + 6 for x in got[n]), (shift, n, got)
        both = repeats.Batch(np.array([0, 1]), np.array([0, 1]), [a, b])
        here = set(repeats.anchors(both, 0)[1].tolist())
        assert all(5 + shift + i in here and len(a) + 11 + i in here for i in range(7))


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_filter_audit"])
def test_audits_with_odd_rows_against_sql(spark, tmp_path, name):
    from hitloom.llm import registry

    rng = random.Random(9)
    text = lambda i: " ".join(rng.choice("the The a of in Übung naïve x# K%t don't été 12 ZZ".split()) for _ in range(rng.randrange(260 if i % 4 else 20)))
    rows = [(i, text(i), ["en", "de", "", None][i % 4 if i % 3 else 0], ["a", "b", "ü", None, "", "B"][i * i % 6]) for i in range(150)]
    rows += [(200 + i, rows[4][1], "en", "abc"[i % 3]) for i in range(20)] + [(None, rows[4][1], "en", "a"), (None, "solo text", "xx", "a"), (None, "solo text", "xx", "b")]
    rows += [(500, None, "en", "only null"), (501, "", "yy", "a"), (502, "", "yy", "b"), (503, None, None, None), rows[7], rows[7], (7, "other text of the same id", "en", "a"), (504, "$" * 5 + " word" * 3000, "de", "long")]
    rows = [(*r, "x", 1, "y", "z") for r in rows]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 220, 2)] + [(None, 1, 1), (4, 1, None), (6, None, 1), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    if name == "op13_filter_audit":  # null ids count as the last, which the SQL of the query has no words for
        sql = registry.oracle_sql()[name].replace("coalesce(w.doc_id > min(w.doc_id) over (partition by text), false)", f"coalesce(w.doc_id, {(1 << 63) - 1}) > min(coalesce(w.doc_id, {(1 << 63) - 1})) over (partition by text)")
    else:
        sql = registry.oracle_sql()[name]
    assert not differences(spark, registry.queries()[name], sql, str(tmp_path), con)


def test_tallies_in_parts(spark):
    """What tasks hand on early adds up to the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    add = lambda df: sorted(map(tuple, df.groupBy("lang", "source", "term").sum("n", "docs").collect()))
    parts = source_audit.term_counts(docs, most=50)
    assert parts.count() > source_audit.term_counts(docs).count() and add(parts) == add(source_audit.term_counts(docs))
    kept = source_audit.kept_terms(docs).cache()
    want, counts = Counter(), [(r["lang"], {s["source"]: s["n"] for s in r["held"]}) for r in kept.collect()]
    for lang, held in counts:
        for a in held:
            want.update((lang, a, b, held[a], held[b]) for b in held if a < b)
    for most in (5, source_audit.MOST_PAIRS):
        got = source_audit.joint_histogram(kept, most=most).collect()
        assert {tuple(r)[:5]: r["n"] for r in got} == dict(want)


def test_audits_of_empty_tables(spark):
    none = frame(spark, [(1, "x", "en", "s")]).limit(0)
    assert source_audit.divergence(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.joint_counts(filter_audit.flag(none), labels)).count() == 0
    one = filter_audit.audit(filter_audit.joint_counts(filter_audit.flag(frame(spark, [(1, "x", "en", "s")])), labels)).collect()
    assert len(one) == 600 and {r["good_lost"] for r in one} == {0}


def test_shapley_is_the_mean_over_all_orders():
    rng = random.Random(3)
    docs = [rng.randrange(32) for _ in range(500)]
    joint = [sum(f & s == s for f in docs) for s in range(32)]
    import numpy as np

    rows = filter_audit.walk(np.array(joint), np.array(joint) // 2 * 0, np.array(joint) * 0)
    removed = Counter()
    for order in permutations("ABCDE"):
        left = list(docs)
        for letter in order:
            bit = 1 << "ABCDE".index(letter)
            removed[letter] += sum(bool(f & bit) for f in left)
            left = [f for f in left if not f & bit]
    assert all(r[8] == removed[r[0][r[1] - 1]] for r in rows)
