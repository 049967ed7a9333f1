"""Geo database files, committed segments, snapshots of lookups."""

import datetime as dt
import ipaddress
import json
import os
import random
import struct

import pytest
from hitloom.operators import lookups
from hitloom.sources import mmdb, segments
from pyspark.sql import functions as F


def encoded(value):
    """An MMDB value, by the public description of the format."""
    head = lambda kind, size: (bytes([kind << 5 | size]) if size < 29 else bytes([kind << 5 | 29, size - 29]) if size < 285 else bytes([kind << 5 | 30]) + (size - 285).to_bytes(2)) if kind < 8 else bytes([size, kind - 7])
    if isinstance(value, bool):
        return head(14, int(value))
    if isinstance(value, dict):
        return head(7, len(value)) + b"".join(encoded(k) + encoded(v) for k, v in value.items())
    if isinstance(value, list):
        return head(11, len(value)) + b"".join(map(encoded, value))
    if isinstance(value, float):
        return head(3, 8) + struct.pack(">d", value)
    if isinstance(value, int):
        raw = value.to_bytes((value.bit_length() + 7) // 8)
        return head(6, len(raw)) + raw
    raw = value.encode()
    return head(2, len(raw)) + raw


def geo_file(networks, bits, size):
    """A database of networks (of both families with bits 128) and their records; nested networks are cut out of wider ones."""
    root, records, places = [None, None], b"", []
    for net, record in sorted(networks, key=lambda n: n[0].prefixlen):
        number, length = int(net.network_address), net.prefixlen
        if bits == 128 and net.version == 4:
            length += 96
        width = bits
        places.append(len(records))
        records += encoded(record)
        node = root
        for i in range(length):
            bit = number >> (width - 1 - i) & 1
            if i == length - 1:
                node[bit] = len(places) - 1
            else:
                if not isinstance(node[bit], list):
                    node[bit] = [node[bit], node[bit]]
                node = node[bit]
    order, todo = [], [root]
    while todo:
        node = todo.pop(0)
        order.append(node)
        todo += [c for c in node if isinstance(c, list)]
    index, n = {id(x): i for i, x in enumerate(order)}, len(order)
    number = lambda c: index[id(c)] if isinstance(c, list) else n if c is None else n + 16 + places[c]
    tree = b""
    for left, right in order:
        a, b = number(left), number(right)
        tree += a.to_bytes(3) + b.to_bytes(3) if size == 24 else a.to_bytes(4) + b.to_bytes(4) if size == 32 else (a & 0xFFFFFF).to_bytes(3) + bytes([a >> 24 << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3)
    meta = {"node_count": n, "record_size": size, "ip_version": 6 if bits == 128 else 4, "database_type": "Test"}
    return tree + bytes(16) + records + b"\xab\xcd\xefMaxMind.com" + encoded(meta)


def place(name, **more):
    return {"country": {"names": {"en": name, "de": name + "land"}}, "n": 7, "ok": True, "at": [1.5, "x" * 40], **more}


@pytest.mark.parametrize("bits,size", [(32, 24), (128, 28), (128, 32)])
def test_geo_database_files(spark, tmp_path, bits, size):
    rng = random.Random(size)
    nets = {ipaddress.ip_network(f"{rng.randrange(1, 224)}.{rng.randrange(256)}.0.0/{rng.randrange(9, 17)}", strict=False) for _ in range(60)}
    nets |= {ipaddress.ip_network(f"10.{i}.{rng.randrange(256)}.0/{rng.randrange(18, 33)}", strict=False) for i in range(30)}
    if bits == 128:
        nets |= {ipaddress.ip_network(f"2001:{rng.randrange(1 << 16):x}::/{rng.randrange(20, 49)}", strict=False) for _ in range(40)}
    networks = [(net, place(f"C{i}", city={"names": {"en": f"town {i}"}} if i % 3 else {})) for i, net in enumerate(sorted(nets, key=str))]
    (tmp_path / "geo.mmdb").write_bytes(geo_file(networks, bits, size))
    spark.dataSource.register(mmdb.MmdbSource)
    columns = "geo_country=country.names.en,geo_city=city.names.en,second=at.1,none=a.b"
    geo = spark.read.format("mmdb").option("columns", columns).load(str(tmp_path / "geo.mmdb"))
    assert geo.columns == ["lo", "hi", "geo_country", "geo_city", "second", "none"] and geo.rdd.getNumPartitions() > 16
    rows = geo.collect()
    spans = sorted((ipaddress.ip_address(r["lo"]).version, int(ipaddress.ip_address(r["lo"])), int(ipaddress.ip_address(r["hi"])), r["geo_country"], r["geo_city"]) for r in rows)
    assert all(a[0] < b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:])) and all(r["second"] == "x" * 40 and r["none"] is None for r in rows)

    def narrowest(ip):
        held = [(net.prefixlen, r) for net, r in networks if net.version == ip.version and ip in net]
        return max(held, key=lambda h: h[0])[1] if held else None

    asked = [ip for net, _ in networks for ip in (net[0], net[-1], net[0] + rng.randrange(net.num_addresses))] + [ipaddress.ip_address("8.8.8.8"), ipaddress.ip_address("9.255.255.255")]
    df = spark.createDataFrame([(str(ip),) for ip in asked], "ip_address string")
    got = {r["ip_address"]: (r["geo_country"], r["geo_city"]) for r in lookups.ip_ranges(df, geo).collect()}
    for ip in asked:
        record = narrowest(ip)
        want = (record["country"]["names"]["en"], record["city"].get("names", {}).get("en")) if record else (None, None)
        assert got[str(ip)] == want, ip


def test_geo_file_that_is_none(spark, tmp_path):
    (tmp_path / "x.mmdb").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        mmdb.database(str(tmp_path / "x.mmdb"))


def test_committed_segments(spark, tmp_path):
    spark.dataSource.register(segments.SegmentSink)
    df = spark.createDataFrame([(i, f"x{i}é", [i, None], dt.datetime(2024, 1, 1), None) for i in range(300)], "id long, name string, xs array<long>, ts timestamp, no string").repartition(3)
    folder = str(tmp_path / "w")
    write = lambda d, **more: d.write.format("segments").mode("append").options(path=folder, table="e v", segment_bytes=2000, **more).save()
    write(df, job="one")
    write(df, job="one")  # again
    files = segments.sealed_files(folder, "e v")
    assert len(files) > 9 and sum(f["rows"] for f in files) == 300 and max(f["bytes"] for f in files) < 2300 and all(f["path"].startswith("e_v/y=") for f in files)
    back = segments.read(spark, folder, "e v", df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    on_disk = {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".ndjson")}
    assert len(on_disk) == len(files)  # what the repeated job had written is gone
    # A task that fails: no row of the job counts.
    bad = df.withColumn("id", F.when(F.col("id") == 299, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        write(bad, job="two")
    assert segments.read(spark, folder, "e v", df.schema).count() == 300
    write(df.limit(5), job="three")
    assert segments.read(spark, folder, "e v", df.schema).count() == 305


def test_committed_stream_batches(spark, tmp_path):
    spark.dataSource.register(segments.SegmentSink)
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    folder = str(tmp_path / "w")

    def run():
        source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = source.writeStream.format("segments").options(path=folder, table="t", checkpointLocation=str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    run()
    ids = lambda: sorted(r["id"] for r in segments.read(spark, folder, "t", spark.range(1).schema).collect())
    assert ids() == list(range(30)) and len(os.listdir(f"{folder}/t/_manifests")) == 3
    # The last batch is lost from the log and so written again: none of its rows counts twice.
    os.remove(str(tmp_path / "state/commits/2"))
    crc = str(tmp_path / "state/commits/.2.crc")
    if os.path.exists(crc):
        os.remove(crc)
    run()
    assert ids() == list(range(30))


def test_snapshots_are_asked_for_each_batch(spark, tmp_path):
    rates = lambda usd, at: spark.createDataFrame([(dt.datetime(2024, 1, at), {"eur": {"usd": usd}})], "created_at timestamp, rates map<string,map<string,double>>")
    rates(1.1, 1).write.parquet(str(tmp_path / "rates/version=1"))
    held = lookups.Snapshots(spark, str(tmp_path / "rates"), lookups.latest_rates)
    assert held().collect()[0]["rate"] == 1.1
    rates(1.2, 2).write.parquet(str(tmp_path / "rates/version=2"))
    assert held().collect()[0]["rate"] == 1.2
    (tmp_path / "rates/version=3").mkdir()  # not finished
    (tmp_path / "rates/version=3/part-0.parquet").write_bytes(b"")
    assert held().collect()[0]["rate"] == 1.2 and json.dumps(held.versions()) == "[1, 2]"

    got = []
    hits = spark.createDataFrame([("p", "a", "h1", "purchase", dt.datetime(2024, 1, 1), None, False)], "property_id string, client_id string, id string, name string, ts timestamp, user_id string, is_late boolean")
    hits = hits.withColumns({c: F.lit(0) for c in ("session_id", "session_hit_number", "session_total_events", "session_duration")}).withColumns({"proto_seq": F.lit(0), "split_idx": F.lit(0), "session_split_cause": F.lit(None).cast("string"), "ip_address": F.lit("10.0.0.1")})
    hits = hits.withColumn("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))).withColumn("query_params", F.create_map(*[x for k, v in {"dl": "https://s.example/", "ep.currency": "EUR", "pr1": "idA~pr10~qt1"}.items() for x in (F.lit(k), F.array(F.lit(v)))]))
    from hitloom.plans import pipeline
    from hitloom.streaming import sessions

    write = sessions.write_wide(pipeline.Options(with_device=False), lambda df, _: got.extend(df.collect()), lambda df, _: df.count(), rates=held)
    write(hits, 0)
    rates(2.0, 3).write.parquet(str(tmp_path / "rates/version=4"))
    write(hits, 1)
    dollars = [r["ecommerce_purchase_revenue_in_usd"] for r in got]
    assert dollars == [12.0, 20.0]
