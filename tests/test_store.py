"""Store, codecs, text format, log and stream, over small cases worked out by hand."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from chronolith.engine import Engine
from chronolith.plans.syntax import parse_selector
from chronolith.sources import codecs, wal
from chronolith.sources.exposition import build_samples, instance_of, read_exposition, render_lines
from chronolith.sources.registry import Registry
from chronolith.sources.store import BUCKET_MS, MetricStore, StoreError
from chronolith.streaming import ingest

SCHEMA = "labels map<string,string>, ts double, value double"


def frame(spark, *rows):
    return spark.createDataFrame([({"__name__": n, **labels}, float(ts), float(v)) for n, labels, ts, v in rows], SCHEMA).coalesce(1)


@pytest.fixture
def store(spark, tmp_path):
    return MetricStore(spark, f"file://{tmp_path}/store")


def rows(df):
    return sorted((r.ts, r.value) for r in df.collect())


def test_upsert_and_import(spark, store):
    changes = store.ingest(frame(spark, ("m", {"job": "a"}, 1000, math.nan), ("m", {"job": "a"}, 2000.4, 1), ("m", {"job": "a"}, 2000, 2), ("m", {}, -5, 1), ("m", {}, math.inf, 1)))
    assert [(r.ts, r.sample_count) for r in changes.collect()] == [(2000, 1)]
    assert rows(store.samples()) == [(2000, 2.0)]
    changes = store.ingest(frame(spark, ("m", {"job": "a"}, 2000, 9), ("n", {"job": "b"}, 1500, 5)))
    assert [(r.ts, r.sample_count) for r in changes.collect()] == [(1500, 1)]
    store.import_samples(frame(spark, ("m", {"job": "a"}, 2000, 7), ("m", {"job": "a"}, 3000, 8)))
    assert rows(store.samples()) == [(1500, 5.0), (2000, 9.0), (3000, 8.0)]
    assert rows(store.select(parse_selector('{job="a"}'), 0, 2500)) == [(2000, 9.0)]
    assert [r.name for r in store.label_names().collect()] == ["__name__", "job"]
    assert [r.value for r in store.label_values("job").collect()] == ["a", "b"]
    assert [r.value for r in store.label_values("job", parse_selector("m")).collect()] == ["a"]
    assert store.series_matching(parse_selector('{job=~".+"}'), 1400, 1600).count() == 1
    stats = store.stats(now=2_000 + 3_600_000)
    assert (stats["seriesCount"], stats["sampleCount"], stats["oldestSampleMs"], stats["newestSampleMs"], stats["samplesLastHour"]) == (2, 3, 1500, 3000, 2)
    assert [(r.bucket_ms, r.sample_count) for r in store.rollup().collect()] == [(0, 3)]
    lines = [json.loads(r.value) for r in store.export_lines([parse_selector('{job="a"}')]).collect()]
    assert lines == [{"metric": {"__name__": "m", "job": "a"}, "values": [9.0, 8.0], "timestamps": [2000, 3000]}]


def test_retention_compaction_and_vacuum(spark, store):
    day = 4 * BUCKET_MS
    store.ingest(frame(spark, *[("old" if t < BUCKET_MS else "new", {}, t, t) for t in range(0, day, BUCKET_MS // 3)]))
    assert store.compact_before(day)["compactedBuckets"] == 0  # written once, a bucket is sorted and without rows to merge
    store.ingest(frame(spark, ("new", {}, BUCKET_MS, 99), ("old", {}, 0, 0)))
    before = rows(store.samples())
    assert store.compact_before(2 * BUCKET_MS + 5, max_buckets=1) == {"complete": False, "cutoffMs": 2 * BUCKET_MS, "compactedBuckets": 1, "compactedPoints": 3, "oldestUncompactedMs": BUCKET_MS}
    assert store.compact_before(2 * BUCKET_MS + 5)["complete"]
    assert rows(store.samples()) == before and (BUCKET_MS, 99.0) in before
    assert store.compact_before(2 * BUCKET_MS)["compactedBuckets"] == 0
    store.ingest(frame(spark, ("new", {}, BUCKET_MS, 100)))  # late data over a merged bucket
    assert (BUCKET_MS, 100.0) in rows(store.samples())
    assert store.delete_before(BUCKET_MS + 1) == 4
    assert rows(store.samples()) == [r for r in before if r[0] > BUCKET_MS]
    assert [r.labels["__name__"] for r in store.series().collect()] == ["new"]
    assert store.vacuum() > 0 and rows(store.samples()) == [r for r in before if r[0] > BUCKET_MS]
    assert store.delete_before_batch(3 * BUCKET_MS, 1) == {"complete": False, "cutoffMs": 3 * BUCKET_MS, "deletedSamples": 2}


def test_retention_reads_ids_not_samples(spark, store):
    """Series go with their last sample; of buckets that no time cuts, only the ids of their series are read."""
    rng = random.Random(5)
    model = {(str(i), t) for i in range(8) for t in rng.sample(range(0, 4 * BUCKET_MS, BUCKET_MS // 9), 2)}
    for part in (0, 1):
        store.ingest(frame(spark, *[("m", {"i": i}, t, 1) for i, t in sorted(model) if (t // (BUCKET_MS // 9)) % 2 == part]))
    for cutoff in (BUCKET_MS // 2, BUCKET_MS, 2 * BUCKET_MS + 77):
        store.delete_before(cutoff)
        model = {(i, t) for i, t in model if t >= cutoff}
        assert {r.labels["i"] for r in store.series().collect()} == {i for i, _ in model}
        store.compact_before(cutoff + BUCKET_MS)
        store.vacuum()
        assert {(r.labels["i"], r.ts) for r in store.samples().join(store.series(), "sid").collect()} == model
    m = store.manifest()
    for part in m.buckets[3 * BUCKET_MS].parts:
        store._delete(part.path)
    store.finalize_retention()
    assert {r.labels["i"] for r in store.series().collect()} == {i for i, _ in model}


def test_retention_of_directories_without_ids(spark, store):
    """Those of a manifest from before ids were kept: their samples are read instead."""
    store.ingest(frame(spark, ("old", {}, 5, 1), ("new", {}, BUCKET_MS + 5, 1)))
    m = store.manifest()
    for b in m.buckets.values():
        for part in b.parts:
            part.ids = None
    store._commit(m)
    store.delete_before(BUCKET_MS)
    assert [r.labels["__name__"] for r in store.series().collect()] == ["new"]


def test_select_at_steps(spark, store):
    store.ingest(frame(spark, *[("dense", {"job": "a"}, s * 1000, s) for s in range(181)]))
    got = store.select_at_steps(parse_selector("dense"), 60_000, 180_000, 30_000, 300_000)
    assert sorted(r.value for r in got.collect()) == [60, 90, 120, 150, 180]
    e = Engine(store.source(0, 200_000))
    assert [v for _, v in e.range_query("dense", 60_000, 180_000, 30_000)["result"][0]["values"]] == ["60", "90", "120", "150", "180"]


def test_random_model(spark, store):
    rng, model = random.Random(7), {}
    for _ in range(4):
        batch = [(rng.randint(1, 5), rng.randrange(0, 3 * BUCKET_MS, BUCKET_MS // 7), rng.choice([-0.0, math.inf, -math.inf, rng.random()])) for _ in range(40)]
        overwrite = rng.random() < 0.6
        (store.ingest if overwrite else store.import_samples)(frame(spark, *[("s", {"i": str(i)}, t, v) for i, t, v in batch]))
        new = {}
        for i, t, v in batch:
            new[str(i), t] = v
        model = {**model, **new} if overwrite else {**new, **model}
        if rng.random() < 0.5:
            store.compact_before(2 * BUCKET_MS)
    got = {(r.labels["i"], r.ts): r.value for r in store.samples().join(store.series(), "sid").collect()}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in model.items()}


STEPS = ("_write_buckets", "_add_series", "_commit", "_delete")


@pytest.mark.parametrize("step", STEPS)
def test_failed_write_can_be_repeated(spark, store, monkeypatch, step):
    """A write that fails at any step leaves the store as it was; repeated, also after vacuum, it takes effect."""
    store.ingest(frame(spark, ("m", {"job": "a"}, 1000, 1)))
    more = frame(spark, ("m", {"job": "a"}, 1000, 2), ("m", {"job": "b"}, 2000, 3))
    for clean in (False, True):
        with monkeypatch.context() as patch:

            def fail(*_):
                raise OSError("lost")

            patch.setattr(MetricStore, step, fail)
            with pytest.raises(OSError, match="lost"):
                store.ingest(more)
        if step != "_delete":  # which comes after the commit
            assert rows(store.samples()) == [(1000, 1.0)] and store.quick_stats()["sampleCount"] == 1
        if clean:
            store.vacuum()
    store.ingest(more)
    assert rows(store.samples()) == [(1000, 2.0), (2000, 3.0)] and store.quick_stats()["seriesCount"] == 2
    store.vacuum()
    assert rows(store.samples()) == [(1000, 2.0), (2000, 3.0)]


def test_manifest_statistics_are_exact(spark, store):
    rng = random.Random(3)
    for k in range(5):
        batch = [("m", {"i": str(rng.randint(0, 3))}, rng.randrange(0, 4 * BUCKET_MS, BUCKET_MS // 5), k) for _ in range(15)]
        (store.ingest if k % 2 else store.import_samples)(frame(spark, *batch))
        if k == 2:
            store.delete_before(BUCKET_MS + BUCKET_MS // 2)
            store.ingest(frame(spark, ("late", {}, BUCKET_MS + 1, 7)))  # before what was deleted: it counts
            assert (BUCKET_MS + 1, 7.0) in rows(store.samples())
        if k == 3:
            store.compact_before(2 * BUCKET_MS)
        times = [t for t, _ in rows(store.samples())]
        found = store.quick_stats()
        assert (found["sampleCount"], found["oldestSampleMs"], found["newestSampleMs"]) == (len(times), min(times), max(times))
        assert found["seriesCount"] == store.series().count() and found["sizeBytes"] > 0
    assert store.quick_stats(now=max(times))["samplesLastHour"] == sum(t >= (max(times) - 3_600_000) // 60_000 * 60_000 for t in times)
    assert store.compact_before(9 * BUCKET_MS, max_samples=1)["compactedBuckets"] == 1


def test_store_options_and_broken_manifests(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = MetricStore(spark, path, bucket_ms=1000, rows_per_file=2)
    store.ingest(frame(spark, *[("m", {"i": str(i)}, 500, i) for i in range(9)]))
    store.ingest(frame(spark, ("m", {"i": "0"}, 1500, 1)))
    assert sorted(store.manifest().buckets) == [0, 1000] and MetricStore(spark, path).bucket_ms == 1000
    for wrong in ({"bucket_ms": 2000}, {"bucket_ms": -1}, {"rows_per_file": 0}):
        with pytest.raises(StoreError):
            MetricStore(spark, path, **wrong)
    newest = sorted((tmp_path / "store" / "manifest").glob("0*.json"))[-1]
    for crc in newest.parent.glob(".*.crc"):
        crc.unlink()
    newest.write_text('{"format": "sam')
    again = MetricStore(spark, path)
    assert again.recovered and rows(again.samples()) == [(500, float(i)) for i in range(9)]
    again.ingest(frame(spark, ("m", {"i": "0"}, 1500, 2)))
    assert MetricStore(spark, path).samples().count() == 10
    newest.write_text('{"format": "other"}')
    newest.with_name("000000000009.json").write_text('{"format": "other"}')
    with pytest.raises(StoreError, match="layout"):
        MetricStore(spark, path)


def test_log_keeps_the_order_of_appends(spark, store, tmp_path):
    """The later append wins, whichever is larger and wherever its files are packed."""
    path = f"{tmp_path}/wal"
    wal.append(frame(spark, *[("m", {}, t, 1) for t in range(50)]), path, per_line=7)
    wal.append(frame(spark, *[("m", {}, t, 2) for t in range(3000)]).repartition(3), path, per_line=7)
    wal.append(frame(spark, ("m", {}, 0, 3)), path)
    assert wal.epoch(spark, path) == 3
    found = wal.replay(spark, path, store, at_once=2)
    assert (found["samples"], found["batches"], found["aborted"]) == (3051, 3, False) and found["bytes"] > 0
    assert rows(store.samples()) == [(t, 2.0 if t else 3.0) for t in range(3000)]
    calls = iter([True, False])
    assert wal.replay(spark, path, store, lambda: next(calls), at_once=1) | {"bytes": 0} == {"samples": 50, "batches": 1, "bytes": 0, "aborted": True}
    wal.append(frame(spark, ("m", {}, 9, 9)), path)
    assert not wal.truncate(spark, path, until=3) and wal.batches(spark, path) == [4]
    assert wal.at_start(spark, path, store)["mode"] == "checkpoint" and wal.batches(spark, path) == []


RAW = "535442310101000003000000E80300000000000004000000180000003A658D15E807E807000000000000F83F00000000000004400000000000000080"
XOR = "535442310101010003000000E803000000000000030000001000000003E0085BE8070000000000000045400080808080808020"


@pytest.mark.parametrize(("block", "points"), [(RAW, ([1000, 2000, 3500], [1.5, 2.5, -0.0])), (XOR, ([1000, 2000, 3000], [42.0, 42.0, 43.0]))])
def test_block_codec(block, points):
    data = bytes.fromhex(block)
    got = codecs.decode_block(data)
    assert (got[0], [repr(v) for v in got[1]]) == (points[0], [repr(v) for v in points[1]])
    assert codecs.encode_block(*points) == data
    for i in range(len(data)):
        with pytest.raises(codecs.CorruptBlock):
            codecs.decode_block(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])


def test_codecs_in_spark(spark):
    codecs.register(spark)
    rng = random.Random(1)
    data = [(k, t * 15_000 + rng.randint(0, 99), rng.random() if k else 42.0) for k in (0, 1) for t in range(3000)]
    df = spark.createDataFrame(data, "sid long, ts long, value double")
    blocks = codecs.pack(df, ["sid"])
    assert blocks.where("sample_count > 2048").count() == 0
    assert sorted(map(tuple, codecs.unpack(blocks, ["sid"]).collect())) == sorted(data)
    assert spark.sql("select tsdb_version() v").first().v == codecs.ENGINE_VERSION
    df.createOrReplaceTempView("points")
    packed = spark.sql("select tsdb_pack(ts, value) p from points where sid = 1").first().p
    assert codecs.decode_block(bytes(packed))[0] == sorted(t for k, t, _ in data if k == 1)
    batch = codecs.encode_batch([(7, 1_700_000_000_123, -0.0), (8, 5, 1.5)])
    assert batch[:8] == b"TSI1\x01\x00\x18\x00" and codecs.decode_batch(batch)[1] == (8, 5, 1.5)
    got = spark.sql(f"select * from tsdb_batch(x'{batch.hex()}')").collect()
    assert [(r.series_id, r.ts) for r in got] == [(7, 1_700_000_000_123), (8, 5)]


EXPOSITION = r"""# HELP foo help
foo 42
bar{} 1e3 1700000000123
http_requests_total{method="GET",code="200",} 1027
esc{a="x\\y",b="q\"r",c="l\nm",d="\\n"} 1
a +Inf
b -Inf
c NaN
d abc
{bad="x"} 1
bad{x=1} 2
bad{x="1" 2
alone
  good   7
h_bucket{le="+Inf"} 3
dup{a="1",a="2"} 4
"""


def test_exposition(spark):
    df = spark.createDataFrame([(EXPOSITION,)], "text string")
    got = {r.name: (dict(r.labels), repr(r.value), r.timestamp_ms) for r in read_exposition(df).collect()}
    assert got == {
        "foo": ({}, "42.0", None),
        "bar": ({}, "1000.0", 1_700_000_000_123),
        "http_requests_total": ({"method": "GET", "code": "200"}, "1027.0", None),
        "esc": ({"a": "x\\y", "b": 'q"r', "c": "l\nm", "d": "\\n"}, "1.0", None),
        "a": ({}, "inf", None),
        "b": ({}, "-inf", None),
        "c": ({}, "nan", None),
        "d": ({}, "nan", None),
        "good": ({}, "7.0", None),
        "h_bucket": ({"le": "+Inf"}, "3.0", None),
        "dup": ({"a": "2"}, "4.0", None),
    }
    assert instance_of("http://LocalHost:9090/metrics") == "localhost:9090" and instance_of("self") == "self"


def test_registry_and_samples(spark):
    reg = Registry("app_", {"env": "t"})
    g = reg.gauge("temp", labels=("instance",))
    g.set(3, {"instance": "x"})
    reg.counter("hits").inc(2)
    assert reg.counter("hits") is reg.counter("hits")
    h = reg.histogram("lat", buckets=(1, 2))
    for v in (0.5, 1, 5):
        h.observe(v)
    with pytest.raises(TypeError):
        h.inc()
    with pytest.raises(ValueError):
        reg.counter("hits").inc(-1)
    flat = {(n, tuple(sorted(x.items()))): v for n, x, v in reg.collect()}
    assert flat[("app_lat_bucket", (("env", "t"), ("le", "1")))] == 2 and flat[("app_lat_bucket", (("env", "t"), ("le", "+Inf")))] == 3
    built = build_samples(reg.frame(spark), F.lit("j"), F.lit("i"), F.lit(5).cast("long")).collect()
    temp = next(r.labels for r in built if r.labels["__name__"] == "app_temp")
    assert temp == {"__name__": "app_temp", "exported_instance": "x", "job": "j", "instance": "i", "env": "t"}
    text = read_exposition(spark.createDataFrame([(reg.text(),)], "text string"))
    assert text.count() == len(flat)
    line = render_lines(frame(spark, ("m", {"b": 'x"\\\n', "a": "1"}, 0, 2.5))).first().value
    assert line == 'm{a="1",b="x\\"\\\\\\n"} 2.5'


def test_log_replay(spark, store, tmp_path):
    path = f"{tmp_path}/wal"
    wal.append(frame(spark, ("m", {}, 1000, 1), ("m", {}, 1000, 2), ("m", {}, 2000, 3)), path)
    (tmp_path / "wal" / "torn.txt").write_text('[{"labels":{"__name__":"m"},"ts":3000,"val')
    assert wal.replay(spark, path, store)["samples"] == 3
    wal.replay(spark, path, store)
    assert rows(store.samples()) == [(1000, 2.0), (2000, 3.0)]


def test_stream(spark, store, tmp_path):
    folder = tmp_path / "scrapes"
    folder.mkdir()
    scrape = {"job": "j", "instance": "i:1", "ts": 1000, "up": True, "duration_seconds": 0.5, "text": "x 1\nx{a=\"b\"} 2\n"}
    (folder / "1.json").write_text(json.dumps(scrape) + "\n" + json.dumps({**scrape, "ts": 2000, "up": False, "text": None}))
    ingest.ingest_stream(ingest.scrape_files(spark, str(folder)), store, f"{tmp_path}/cp").awaitTermination(120)
    e = Engine(store.source())
    values = lambda q, t: sorted(r["value"][1] for r in e.instant_query(q, t)["result"])
    assert values("x", 1000) == ["1", "2"] and values("up", 1000) == ["1"] and values("up", 2000) == ["0"]
    assert values("scrape_samples_scraped", 1000) == ["2"]
    statuses = spark.createDataFrame([(True, 90_000, None, 15), (False, 10_000, "boom", 15), (None, None, None, 15)], "up boolean, last_scrape_ms long, last_error string, interval_seconds int")
    r = ingest.summarize_health(statuses, 100_000).first()
    assert (r.targets, r.up, r.down, r.pending, r.stale, r.last_scrape_ms, r.last_error) == (3, 1, 1, 1, 1, 90_000, "boom")


@pytest.mark.parametrize("late", [None, 60_000])
def test_window_counts_of_a_stream(spark, tmp_path, late):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"labels_key": "a", "ts": t, "value": float(t)} for t in (1000, 2000, 2001, 4000)]
    (folder / "1.json").write_text("\n".join(json.dumps(r) for r in rows))
    stream = spark.readStream.schema("labels_key string, ts long, value double").json(str(folder))
    name = f"windows_{late}"
    query = ingest.window_counts(stream, 2000, 1000, late).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.step: (r.sum, r["count"]) for r in spark.table(name).collect()}
    assert got == {1000: (1000.0, 1), 2000: (3000.0, 2), 3000: (4001.0, 2), 4000: (6001.0, 2), 5000: (4000.0, 1)}
