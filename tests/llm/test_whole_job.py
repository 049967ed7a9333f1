"""Rows that an operator or a stage must not lose, against plain models."""

import random
import re
from collections import Counter

import corpus_pipeline as p
import numpy as np
from hitloom.llm import ann, bpe, common, lang_id, mixing, near_dup, quality_model
from pyspark.sql import functions as F
from test_text_ops import classes_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_near_duplicates_stage_keeps_one_row_a_class(spark):
    a, b, c, d, e = (prose(i) for i in range(5))
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (2, a + " more"), (3, d), (3, e), (3, d), (4, d), (None, None), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted(map(str, ((r["doc_id"], r["text"]) for r in p.near_duplicates(spark, df, None).collect())))
    # Of a class the least id, null ids last; texts without words are classes of their own row.
    assert got == sorted(map(str, [(2, a + " more"), (None, b), (1, c), (3, d), (3, e), (None, None), (None, None), (None, "")]))


def test_near_duplicates_with_a_repeated_line(spark):
    rows = []
    for i in range(12):
        text = prose(100 + i, 120)
        rows += [(2 * i, text), (2 * i + 1, text + (" " + prose(200 + i, 16)) * 400)]  # 116 shingles, and 20 others
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_model(rows) and got[1] == 0


def test_near_duplicates_of_rows_without_ids(spark):
    texts = [prose(i, 60) for i in range(8)]
    rows = [(None, texts[i % 4]) for i in range(400)] + [(5, texts[4])] * 300 + [(5, texts[5]), (6, texts[4] + " more"), (None, texts[6]), (7, texts[6] + " x y")]
    got = near_dup.near_duplicates(spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long"), carry=("k",)).collect()
    want = [None] * 400 + [5] * 300 + [5, 5, 7, 7]
    assert [r["class_id"] for r in sorted(got, key=lambda r: r["k"])] == want and len(got) == len(rows)


def test_neighbours_stop_late_enough():
    x = np.random.default_rng(5).standard_normal((8000, 16))
    ids, q = np.arange(8000), np.arange(0, 8000, 20)
    score = ann.unit(x[q]) @ ann.unit(x).T
    score[np.arange(len(q)), q] = -9
    best = np.argsort(-score, axis=1)[:, :5]
    a, b, _, tried = ann.Block(ids, x).search(q, x[q], np.full(len(q), np.inf), 5)
    assert 0 < tried < len(q) * len(x)
    found = set(zip(q[a].tolist(), b.tolist()))
    assert np.mean([(int(q[i]), int(v)) in found for i in range(len(q)) for v in best[i]]) >= 0.998


def test_neighbours_in_clusters_verify_few_pairs():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((200, 32)), 40, axis=0) + 0.05 * rng.standard_normal((8000, 32))
    q = np.arange(0, 8000, 40)
    a, b, score, tried = ann.Block(np.arange(8000), x).search(q, x[q], np.full(len(q), np.inf), 5)
    true = ann.unit(x[q]) @ ann.unit(x).T
    true[np.arange(len(q)), q] = -9
    assert np.allclose(score.reshape(-1, 5), -np.sort(-true, axis=1)[:, :5]) and tried < 0.05 * len(q) * len(x)


def test_neighbours_of_repeated_queries_and_rare_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "LENGTHS", 1, raising=False)
    x = np.random.default_rng(7).standard_normal((300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, x[50].tolist())] * 2 + [(100, x[201].tolist())]
    for size in range(9, 75):  # more lengths than any limit, three rows each
        rows += [(50 * size, [1.0] * size), (1000 + size, [1.0] * (size - 1) + [2.0]), (2000 + size, [1.0] * (size - 1) + [3.0])]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    wanted = []
    for i, v in sorted({(i, tuple(v)) for i, v in rows if i % 50 == 0}):
        u = [(-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w in rows if len(w) == len(v) and j != i]
        wanted += [(i, n + 1, j) for n, (_, j) in enumerate(sorted(u)[:5])]
    assert sorted(r[:3] for r in got) == sorted(wanted)


def test_language_sample_keeps_small_languages(spark):
    sizes = {f"l{i:02}": n for i, n in enumerate([6000, 5000, 4000, 3000, 2500, 2000, 1800, 1500, 1200, 1000, 800, 15])}
    rows, rng = [], random.Random(6)
    for i, (lang, n) in enumerate(sizes.items()):
        letters = [chr(0x4E00 + 20 * i + k) for k in range(12)]
        rows += [(len(rows) + k, "".join(rng.choice(letters) for _ in range(20)), lang) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = lang_id.train(df, each=30, most=300)
    assert model.langs == sorted(sizes)
    small = lang_id.identify(df.where("lang = 'l11'"), model).collect()
    assert len(small) == 15 and {r["lang_pred"] for r in small} == {"l11"}


def test_mix_stage_uses_rows_in_training_order(spark):
    texts = [prose(i, 5 + i % 30) for i in range(300)]
    rows = [(i, t, "en", "abc"[i % 3], i) for i, t in enumerate(texts)]
    got = [(r["doc_id"], r["n_chars"]) for r in p.mix_sources(spark, spark.createDataFrame(rows, DOCS), None).collect()]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    uses = [(t, r["source"], r["doc_id"]) for r in mixed for t in (r["position"], r["second_position"]) if t is not None]
    assert got == [(i, i) for _, _, i in sorted(uses)]
    # All ids null or equal: still at most two uses of a row, and the words that the targets say.
    odd = spark.createDataFrame([(None if i % 2 else 7, *r[1:]) for i, r in enumerate(rows)], DOCS)
    times = Counter(r["text"] for r in p.mix_sources(spark, odd, None).collect())
    words = Counter()
    for i, t in enumerate(texts):
        words["abc"[i % 3]] += times[t] * (5 + i % 30)
    assert max(times.values()) <= 2
    for r in mixing.mix_sources(odd).select("source", "target").distinct().collect():
        assert r["target"] - 1 <= words[r["source"]] <= r["target"] + 70  # the last document of each turn is used in part


def test_language_stage(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(("der und die nicht", "the and with not")[i % 2].split()) for _ in range(20)), ("de", "en")[i % 2] if i < 180 else None, "s", 0) for i in range(200)]
    odd = [(300, None, "de", "s", 0), (301, "12 !", "en", "s", 0), (302, "", None, "s", 0)]
    got = p.language_id(spark, spark.createDataFrame(rows + odd, DOCS), None).collect()
    assert sorted((r["doc_id"], r["lang"]) for r in got) == [(i, ("de", "en")[i % 2]) for i in range(200)]
    none = spark.createDataFrame([(i, t, None, s, n) for i, t, _, s, n in rows + odd], DOCS)
    assert sorted(tuple(r) for r in p.language_id(spark, none, None).collect()) == [(i, t, None, s, n) for i, t, _, s, n in rows]


def clash(df):
    """df with columns of names that the operators use themselves."""
    return df.withColumns({name: F.lit("x") for name in ("score", "row", "order", "bins", "lang_pred", "ids", "label", "position", "size")})


def odd_rows():
    rng = random.Random(31)
    good = lambda: " ".join(rng.choice("the house and garden were quiet in the evening light".split()) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["$#|", "zz%%", "@@@", "x<>"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "en", "ab"[i % 2], 0) for i in range(120)]
    return rows + [(3, rows[4][1], "en", None, 0), (None, rows[5][1], "en", "a", 0), (None, None, None, None, None), (7, "", "en", "a", 0), rows[8], rows[8], (500, good() * 400, "en", "a", 0), (501, bad() * 400, None, "b", 0)]


def test_quality_stage_against_scoring_each_row_by_hand(spark, tmp_path):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, DOCS)
    labels = [(i, int(i % 3 > 0), 0) for i in range(120)] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model, bins = quality_model.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))), quality_model.Features()
    want = [r for r in rows if model.score(bins(r[1])) >= quality_model.THRESHOLD]
    got = [tuple(r) for r in p.quality_classifier(spark, clash(docs), str(tmp_path)).collect()]
    assert Counter(map(str, got)) == Counter(map(str, want)) and 60 < len(want) < len(rows)
    kept = {r[0] for r in want}
    assert 500 in kept and 501 not in kept


def test_bpe_stage_against_the_library(spark):
    from tokenizers import Tokenizer

    library, rows = Tokenizer.from_file(bpe.vocabulary_path()), odd_rows()
    got = p.bpe_encoding(spark, clash(spark.createDataFrame(rows, DOCS)), None).collect()
    want = [(i, source, library.encode(t or "", add_special_tokens=False).ids) for i, t, _, source, _ in rows]
    assert Counter(str((r["doc_id"], r["source"], np.frombuffer(r["ids"], dtype=np.uint32).tolist())) for r in got) == Counter(map(str, want))
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)


def test_stages_on_clashing_columns_and_empty_tables(spark, tmp_path):
    docs = clash(spark.createDataFrame(odd_rows(), DOCS))
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in p.STAGES:
        columns = list(p.COLUMNS) if stage is not p.bpe_encoding else ["doc_id", "source", "n_tokens", "ids"]
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.columns == columns and none.count() == 0, name
        if stage in (p.near_duplicates, p.language_id, p.mix_sources):
            assert stage(spark, docs, str(tmp_path)).columns == columns, name


def test_spread_joins_have_one_plan(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(70)], "k long, v long")
    cold = common.join_spread(rows, rows.groupBy("k").count(), "k", "v", common.hot_keys(rows, "k", 70, steady=True))
    assert cold.count() == 70 and len(cold.collect()) == 70
    done = cold._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert done.count("LeftOuter") == 2  # the joins with hot keys are there though no key is hot
    many = spark.createDataFrame([(0, i) for i in range(600)] + [(1, i) for i in range(300)] + [(2, 0)], "k long, v long")
    hot = common.hot_keys(many, "k", many.count(), steady=True)
    assert sorted(tuple(r) for r in hot.collect()) == [(0, 3), (1, 2)]  # the key 0 is there once
    assert common.join_spread(many, many.groupBy("k").count(), "k", "v", hot).count() == 901


def test_few_named_rows_move_no_shingles(spark):
    wide = spark.createDataFrame([(i, [i] * 3) for i in range(50)], "__row long, shingles array<int>").repartition(4, "shingles")
    named = spark.createDataFrame([(i,) for i in range(0, 50, 5)], "__row long")
    plans = []
    for few in (10, 9):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            got = near_dup.rows_named(wide, named, few)
            assert sorted(r[0] for r in got.collect()) == list(range(0, 50, 5))
            plans.append(got._jdf.queryExecution().executedPlan().toString())
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]


def test_near_duplicates_plans_stay_small(spark, monkeypatch):
    rows = []
    for i in range(6):
        text = prose(300 + i, 80)
        rows += [(10 * i + k, text + f" tail{k}") for k in range(6)]
    joins, write = [], near_dup.materialize

    def counted(df):
        joins.append(len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString())))
        return write(df)

    monkeypatch.setattr(near_dup, "materialize", counted)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_model(rows)
    assert max(joins) <= 8  # what a plan holds twice, the driver holds twice
