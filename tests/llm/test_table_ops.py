"""Chat, mixing, neighbours and the pipeline against plain models."""

from collections import defaultdict

import numpy as np
import pytest
from compare import differences
from hitloom.llm import ann, chat, mixing, registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_oracles(spark):
    for name, sql in registry.oracle_sql().items():
        assert not differences(spark, registry.queries()[name], sql, SF)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "~0 <|im_end|>\n<|~2"), (1, 1, "assistant", "<<|x ~~1\n"), (1, 1, "assistant", "<<|x ~~1\n"), (2, None, None, None), (None, 3, "a\nb~<|", "t<"), (3, 0, "assistant", "é" * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, log string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(chat.messages_as_log(df)))).collect()}
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == dict(want)
    assert chat.fold(chat.messages_as_log(df.limit(0))).count() == 0
    for r in got.values():  # the mask covers the assistant's escaped texts and nothing else
        texts = [r["formatted"][x["start"] : x["start"] + x["length"]] for x in r["loss_spans"]]
        assert [t.replace("~2", "<|").replace("~0", "~") for t in texts] == [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        assert all(r["formatted"][: x["start"]].endswith("<|im_start|>assistant\n") and r["formatted"][x["start"] + x["length"] :].startswith("<|im_end|>\n") for x in r["loss_spans"])
    one = got[1]["formatted"]
    assert one.count("<|im_start|>") == one.count("<|im_end|>") == 3


def test_chat_of_many_turns(spark):
    """More turns than runs of the running total, so that spans lie in the right place, in about one pass."""
    import time

    rows = [(1, i, "assistant" if i % 2 else "user", f"é~{'x' * (i % 7)}<|{i}") for i in range(6000)] + [(2, 0, "assistant", "a"), (3, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.time()
    got = {r["conv_id"]: r for r in chat.under_mask(chat.read_back(chat.render(chat.fold(chat.messages_as_log(df))))).collect()}
    assert time.time() - began < 20
    for c in (1, 2, 3):
        said = [t for k, _, role, t in rows if k == c and role == "assistant"]
        r = got[c]
        assert r["under_mask"] == "".join(said) and len(r["loss_spans"]) == len(said)
        for s, text in zip(r["loss_spans"], said):
            assert r["formatted"][s["start"] : s["start"] + s["length"]].replace("~2", "<|").replace("~0", "~") == text and r["turns"][s["turn"]]["text"] == text
    sums = df.limit(1).select(chat.running_total(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda v: v.cast("long"))).alias("s")).collect()[0]["s"]
    assert sums == [i * (i + 1) // 2 for i in range(1000)]


def test_chat_events(spark):
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "He"), (1, 1, 2, "delta", "assistant", "llo"), (1, 1, 3, "regenerate", "assistant", "G"), (1, 1, 4, "delta", "assistant", "ood"), (1, 0, 5, "edit", "user", "hey"), (1, 2, 6, "delta", "user", "bye"), (1, 3, 7, "message", "user", "a"), (1, 3, 8, "edit", "tool", "b"), (1, 3, 9, "delta", None, "c"), (1, 4, 10, "message", "user", "d"), (1, 4, 11, "edit", None, "e")]
    df = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    assert [tuple(t) for t in chat.fold(df).collect()[0]["turns"]] == [("user", "hey"), ("assistant", "Good"), ("user", "bye"), ("tool", "bc"), ("user", "e")]


def targets_model(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, target = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0)
    open_ = set(names)
    while goal > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        over = 0.0
        for s in list(open_):
            target[s] += goal * w[s] / total
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                over += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
        goal = over
    return target


def test_mixing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 60)) if i % 17 else None, [None, "a", "é", "b", "c", "hot", "hot", "hot"][i % 8], "x") for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.orderBy(F.desc("doc_id"))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken, said = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == len((rows[r["doc_id"]][1] or "").split()) and r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        said[r["source"]] = r["target"]
    want = targets_model(sizes)
    for s in sizes:
        assert said[s] == pytest.approx(want[s]) and abs(taken[s] - said[s]) <= 1
    order = mixing.training_order(mixing.mix_sources(df)).collect()
    places = [r["position"] for r in order]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    assert mixing.mix_sources(df.limit(0)).count() == 0
    # Each position inverts the integral of its source's schedule: found again by halving.
    slope = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), mixing.SLOPES * 9))
    by_source = defaultdict(list)
    for r in got:
        if r["size"]:
            by_source[r["source"]].append(r)
    for s, rows_of in by_source.items():
        start, goal = 0, want[s]
        for r in sorted(rows_of, key=lambda r: (r["position"] is None, r["position"])):
            for place, said_at in ((start, r["position"]), (start + sizes[s], r["second_position"])):
                assert (said_at is None) == (place >= int(goal + 1e-6))
                if said_at is not None:
                    low, high = 0.0, 1.0
                    for _ in range(60):
                        t = (low + high) / 2
                        low, high = (t, high) if goal * (t + slope[s] * (t * t - t)) < place else (low, t)
                    assert said_at == pytest.approx(low, abs=1e-6)
            start += r["size"]


def test_mixing_repeated_rows_long_texts_and_spans(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    monkeypatch.setattr(mixing, "SPAN", 3)
    rows = [(1, "a b c", "s")] * 40 + [(2, "w " * 100_000, "s"), (None, "x y", "s"), (None, "x y", "s"), (3, "", None), (4, None, "t")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and sum(r["taken"] for r in got) == int(1.5 * (120 + 100_000 + 4)) and all(r["taken"] <= 2 * r["size"] for r in got)


def test_mixing_carries_columns_of_any_name(spark):
    names = ["h", "s", "r", "slope", "range", "z", "p", "span", "n_docs", "level", "local_start", "__h", "__n", "a`b", "c d"]
    rows = [(i // 2, "w " * (i % 9), "ab"[i % 2], -1.0, "no", *[i * 100 + k for k in range(len(names))]) for i in range(60)]
    rows += [rows[5]] * 30 + [rows[6]]
    kind = ", ".join(["doc_id long", "text string", "source string", "position double", "Size string", *[f"`{n.replace('`', '``')}` long" for n in names]])
    df = spark.createDataFrame(rows, kind)
    mixed = mixing.mix_sources(df, carry=(*names, "position", "Size"))
    assert mixed.columns == [*mixing.OUT, *names]
    got, plain = mixed.collect(), mixing.mix_sources(df).collect()
    want = sorted((r[0], r[2], len(r[1].split()), *r[5:]) for r in rows)
    assert sorted((r[0], r[1], r[2], *r[len(mixing.OUT) :]) for r in got) == want
    total = lambda rows_of: {s: sum(r["taken"] for r in rows_of if r["source"] == s) for s in "ab"}
    assert total(got) == total(plain) and len(plain) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[500:1500] = x[500]  # one vector holds a third of all rows
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(5000, None, "z"), (5050, [], "z"), (5100, [0.0] * 24, "z"), (5150, [float("nan")] * 24, "z"), (5200, [1.0, 2.0], "z"), (5250, [2.0, 1.0], "z"), (None, [1.0] * 24, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = total = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        hits += len({*best.tolist()} & {v for v, _ in got[q]})
        total += 5
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) and len(got[q]) == 5
    assert hits / total >= 0.9
    assert [v for v, _ in got[5200]] == [5250] and not {5000, 5050, 5100, 5150} & set(got)
    assert ann.nearest(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p
    from hitloom.llm.common import table

    docs = table(spark, SF, "documents")
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, p.materialize(stage(spark, docs, SF))
        assert docs.columns == list(p.COLUMNS), name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    last = p.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.columns == ["doc_id", "source", "n_tokens", "ids"]
