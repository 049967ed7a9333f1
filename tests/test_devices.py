"""Pattern databases against plain ordered search."""

import random
import re

import pytest
from hitloom.operators import devices, lookups
from pyspark.sql import functions as F


@pytest.mark.parametrize("pattern,text", [
    (r"Chrome/(\d+)", "chrome/"), (r"(?:^|[^A-Z])SM-(?:A|B)\d", "sm-"), (r"ab|cd", ""), (r"x?(Firefox|Focus)+/v", ""), (r"(?:MiuiBrowser)+/\d*", "miuibrowser"), (r"a.b.c", ""), (r"\bBRAVIA\b 4K", "bravia 4k"), (r"(?:Kindle)?Fire", "fire"), (r"ſtraße", "tra"),
])
def test_needed_text(pattern, text):
    assert devices.needed_text(pattern) == text


def test_prefilter_equals_ordered_search():
    rng, rows = random.Random(5), []
    word = lambda n=4: "".join(rng.choice("abcdXYZ") for _ in range(n))
    for i in range(1500):
        a, b = word(), word()
        rows.append({"section": "browser", "place": i, "regex": rng.choice([rf"{a}/(\d+)", f"(?:{a}|{b})z", rf"{a}.*{b}", rf"\b{a}[12]?{b}", f"{a[:2]}[-_]"]), "name": f"n{i}", "version": "$1"})
    section, found = devices.Section(rows), 0
    for _ in range(400):
        agent = " ".join(rng.choice([word(), word() + "/12", word() + "z", word(2) + "-", rng.choice(rows)["regex"][:4] + "/3"]) for _ in range(6))
        want = next((r for r in rows if re.search(r["regex"], agent, re.I)), None)
        got = section.find(agent)
        assert (got and got[0]) == want
        found += want is not None
    assert 50 < found and len(section.always) < len(rows) / 2


def test_lists_from_files(spark, tmp_path):
    (tmp_path / "bots.yml").write_text("- regex: 'Foobot/([\\d.]+)'\n  name: 'Foo Bot'\n")
    (tmp_path / "browsers.yml").write_text("- regex: 'Quark(?:/(\\d+[.\\d]+))?'\n  name: 'Quark'\n  version: '$1'\n- regex: 'Zed(\\d)'\n  name: 'Zed $1'\n")
    (tmp_path / "models.yml").write_text("Acme:\n  regex: '(Acme|ACM)[ -]'\n  device: 'smartphone'\n  models:\n    - regex: 'Acme Pad (\\d+)'\n      model: 'Pad $1'\n      device: 'tablet'\n    - regex: 'ACM-([a-z]+)'\n      model: 'Phone $1'\nBolt:\n  regex: 'Bolt (\\w+)'\n  device: 'tv'\n  model: 'B $1'\n")
    database = devices.read_database(spark, {"bot": str(tmp_path / "bots.yml"), "browser": str(tmp_path / "browsers.yml"), "model": str(tmp_path / "models.yml")})
    agents = ["Mozilla/5.0 (Linux; Android 12; Acme Pad 7) Quark/3.1", "x ACM-neo Quark", "Foobot/2.1", "Bolt max Zed4", "Mozilla/5.0 (Windows NT 6.1) Chrome/99.0", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(agents)], "i int, agent string").withColumn("headers", F.when(F.col("agent").isNotNull(), F.create_map(F.lit("User-Agent"), F.array("agent"))))
    rows = devices.with_device(df, database).orderBy("i").collect()
    got = [(r["device_category"], r["device_mobile_brand_name"], r["device_mobile_model_name"], r["device_web_browser"], r["device_web_browser_version"]) for r in rows]
    assert got == [("tablet", "Acme", "Pad 7", "Quark", "3.1"), ("smartphone", "Acme", "Phone neo", "Quark", None), ("bot", "Foo Bot", None, None, None), ("tv", "Bolt", "B max", "Zed 4", None), ("desktop", None, None, "Chrome", "99.0"), (None,) * 5]
    assert rows[4]["device_operating_system_version"] == "7" and list(lookups.DEVICE) == rows[0].__fields__[-len(lookups.DEVICE) :]
    with pytest.raises(re.error):
        devices.with_device(df, spark.createDataFrame([("bot", 0, "(", "x", None, None, None)], devices.DATABASE))


@pytest.mark.parametrize("pattern,texts", [
    (r"(?:^|[^A-Z0-9])mx-(12)[a-f]", ["mx-12"]), (r"Android (\d+)[;)] (?:.*)X17Y?\b", ["android ", "x17"]), (r"a(b)+cde", ["cde"]), (r"(foo|bar)quux", ["quux"]),
])
def test_needed_texts(pattern, texts):
    assert devices.needed_texts(pattern) == texts


def test_a_text_that_all_patterns_share_is_not_their_key():
    section = devices.Section([{"regex": rf"Android (\d+)[;)] (?:.*)X{k}Y"} for k in range(100, 400)])
    assert section.find("Android 12; X399Y")[0]["regex"].endswith("X399Y") and len(section.compiled) == 1


def test_large_databases_are_joined(spark):
    rng, rows = random.Random(6), []
    word = lambda n=4: "".join(rng.choice("abcdXYZ") for _ in range(n))
    for i in range(1500):
        a, b = word(), word()
        regex = rng.choice([rf"{a}/(\d+)", f"(?:{a}|{b})z", rf"{a}.*{b}", rf"\b{a}[12]?{b}", f"({a})-{a * 5}"])
        rows.append((rng.choice(["bot", "browser", "system", "model", "model"]), i // 2, regex, rng.choice(["n$1", f"n{i}", ""]), rng.choice([None, "$1"]), rng.choice([None, f"b{i}"]), rng.choice([None, "", "tablet"])))
    database = spark.createDataFrame(rows, devices.DATABASE)
    agents = [" ".join(rng.choice([word(), word() + "/1_2", word() + "z", "é", word() + rng.choice(rows)[2][:4], (w := word()) + "-" + w * 5]) for _ in range(rng.randrange(1, 7))) for _ in range(300)] + [None, "", "x"]
    df = spark.createDataFrame([(i, a, rng.choice([None, '"M1"']), rng.choice([None, '"macOS"'])) for i, a in enumerate(agents * 2)], "i int, agent string, m string, p string")
    df = df.select("i", F.when(F.col("agent").isNotNull(), F.create_map(F.lit("User-Agent"), F.array("agent"), F.lit("Sec-Ch-Ua-Model"), F.array("m"), F.lit("Sec-Ch-Ua-Platform"), F.array("p"))).alias("headers"))
    sent, joined = (sorted(map(str, devices.with_device(df, database, most=most).drop("headers").collect())) for most in (2000, 10))
    assert sent == joined and len(sent) == 606 and len({r.split(", ", 1)[1] for r in sent}) > 60


def test_no_table_that_grows_is_broadcast(spark, tmp_path, monkeypatch):
    plans, settled = [], devices.settled
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(devices, "settled", lambda df: settled(plan(df)))
    rows = [("browser", i, rf"surf{i}/(\d+)", f"Surf {i}", "$1", None, None) for i in range(300)] + [("model", i, rf"(?:^| )m{i}\b", f"M{i}", None, "Maker", "tablet") for i in range(12)] + [("bot", 0, r"z+", "Z", None, None, None)]
    spark.createDataFrame(rows, devices.DATABASE).write.parquet(str(tmp_path / "database"))
    database = spark.read.parquet(str(tmp_path / "database"))  # of a known, small size
    agents = [None, "", "Zzz", *[f"Surf{i}/{i} m{i % 12} SURF{i // 3}/1" for i in range(0, 300, 5)], *["Surf7/2"] * 30]
    df = spark.createDataFrame(list(enumerate(agents)), "i int, agent string").select("i", F.when(F.col("agent").isNotNull(), F.create_map(F.lit("User-Agent"), F.array("agent"))).alias("headers"))
    want = sorted(map(str, devices.with_device(df, database).drop("headers").collect()))
    for hot in (4, 10_000):  # with hot texts and agents, and without
        monkeypatch.setattr(devices, "HOT", hot, raising=False)
        assert sorted(map(str, plan(devices.with_device(df, database, most=10)).drop("headers").collect())) == want
    assert {k for p in plans for k in re.findall(r"BroadcastHashJoin \[(\w+)#", p)} <= {"_key", "_row"} and len(plans) > 2  # hot keys, hot or few rows
