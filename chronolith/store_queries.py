"""Registered queries of the store, its metadata, the codecs and the text format, each with checking SQL.

They write ``events``, times cut to minutes, into a scratch store as a first
batch and every third event again, with other values and some times moved, as a second.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Api
from .engine import Engine
from .plans.syntax import NAME, parse_selector
from .shape import panels
from .sources import codecs, derived, wal
from .sources.exposition import parse_lines, render_lines
from .sources.store import MetricStore
from .streaming.ingest import samples_of

#: 2024-01-10, and a bucket's start and a moment of some days later.
CUT = 1_704_844_800_000
LATER = CUT + 5 * 86_400_000 + 12_345_000


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, under the checkpoint folder. Without one, only a local session gets a temporary folder."""
    context = spark.sparkContext
    place = context._jsc.sc().getCheckpointDir()
    root = place.get() if place.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
    return f"{root if ':' in root else 'file://' + root}/stores/{uuid.uuid4().hex}"


def first_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.events(spark, sf_dir)
    labels = F.create_map(F.lit(NAME), F.lit("ev"), F.lit("event_type"), "event_type")
    return rows.select(labels.alias("labels"), (F.col("t") - F.col("t") % 60_000).alias("ts"), "value", "event_id")


def second_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_batch(spark, sf_dir).where("event_id % 3 = 0")
    return rows.withColumns({"ts": F.col("ts") + 60_000 * (F.col("event_id") % 2), "value": F.col("value") + 1000})


def _store(spark: SparkSession, sf_dir: str, *more: str) -> MetricStore:
    store = MetricStore(spark, scratch(spark))
    store.ingest(first_batch(spark, sf_dir), "event_id")
    for how in more:
        getattr(store, how)(second_batch(spark, sf_dir), "event_id")
    return store


def _flat(store: MetricStore, samples: DataFrame | None = None) -> DataFrame:
    rows = (store.samples() if samples is None else samples).join(store.series(), "sid")
    return rows.select(F.col("labels")["event_type"].alias("event_type"), "ts", F.round("value", 6).alias("value"))


def sk1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_store(spark, sf_dir, "ingest"))


def sk2_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_store(spark, sf_dir, "import_samples"))


def sk3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).ingest(second_batch(spark, sf_dir), "event_id")


def sk5_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping appends, the later one smaller, then a third that repeats some of the first."""
    path = scratch(spark)
    wal.append(first_batch(spark, sf_dir).orderBy("event_id"), path)
    wal.append(second_batch(spark, sf_dir).orderBy("event_id"), path)
    wal.append(first_batch(spark, sf_dir).where("event_id % 6 = 1").orderBy("event_id"), path)
    store = MetricStore(spark, scratch(spark))
    wal.replay(spark, path, store)
    return _flat(store)


def sk7_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _store(spark, sf_dir).export_lines([parse_selector('ev{event_type=~"c.*"}')], CUT, LATER)
    parsed = lines.select(F.from_json("value", "metric map<string,string>, values array<double>, timestamps array<long>").alias("x"))
    points = parsed.select(F.col("x.metric")["event_type"].alias("event_type"), F.explode(F.arrays_zip("x.timestamps", "x.values")).alias("p"))
    return points.select("event_type", F.col("p.timestamps").alias("ts"), F.round("p.values", 6).alias("value"))


def sc1_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _store(spark, sf_dir, "ingest").select(parse_selector('{event_type!="click"}'), CUT, LATER)
    return rows.select(F.col("labels")["event_type"].alias("event_type"), "ts", F.round("value", 6).alias("value"))


def sc2_select_at_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _store(spark, sf_dir).select_at_steps(parse_selector("ev"), CUT, LATER, 21_600_000, 3_600_000)
    return rows.select(F.col("labels")["event_type"].alias("event_type"), "ts", F.round("value", 6).alias("value"))


def d1_series_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _store(spark, sf_dir).series_matching(parse_selector('{event_type=~".*c.*"}'), CUT, CUT + 3_600_000)
    return found.select(F.col("labels")["event_type"].alias("event_type"))


def d2_label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).label_names()


def d3_label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).label_values("event_type")


def d4_delete_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, "ingest")
    store.delete_before(LATER)
    return _flat(store)


def d5_delete_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.delete_before_batch(LATER, 10**9)
    store.finalize_retention()
    return _flat(store)


def d7_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, "ingest")
    store.compact_before(LATER)
    return _flat(store)


def d11_quick_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the manifest of a store with overwritten, deleted and late samples."""
    store = _store(spark, sf_dir, "ingest")
    store.delete_before(LATER)
    store.import_samples(first_batch(spark, sf_dir).where(f"ts < {CUT} AND event_id % 7 = 0"), "event_id")
    s = store.quick_stats()
    return spark.range(1).select(F.lit(s["seriesCount"]).cast("long").alias("series_count"), F.lit(s["sampleCount"]).cast("long").alias("sample_count"), F.lit(s["oldestSampleMs"]).cast("long").alias("oldest"), F.lit(s["newestSampleMs"]).cast("long").alias("newest"))


def d12_count_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _store(spark, sf_dir, "ingest").count_samples()
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


def d16_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of one store exported and imported into another that holds some of them already."""
    old, new = _store(spark, sf_dir, "ingest"), MetricStore(spark, scratch(spark))
    new.ingest(second_batch(spark, sf_dir).withColumn("value", F.lit(0.5)), "event_id")
    new.import_samples(old.export_samples())
    return _flat(new)


def sc10_export_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _store(spark, sf_dir, "ingest").export_samples()
    return rows.select(F.col("labels")["event_type"].alias("event_type"), "ts", F.round("value", 6).alias("value"))


def h3_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The API's union of two selectors over a time range."""
    api = Api(_store(spark, sf_dir))
    _, body = api.handle("/api/v1/series", {"match[]": ['ev{event_type=~"c.*"}', 'ev{event_type=~".*c.*"}'], "start": [str(CUT / 1000)], "end": [str(LATER / 1000)]})
    return spark.createDataFrame([(m[NAME], m["event_type"]) for m in body["data"]], "name string, event_type string")


def h2_query_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The API's range query, whose buckets are pruned by the query's own reach."""
    api = Api(_store(spark, sf_dir))
    _, body = api.handle("/api/v1/query_range", {"query": ["sum by (event_type) (sum_over_time(ev[6h] offset 1h))"], "start": [str(CUT // 1000)], "end": [str(CUT // 1000 + 5 * 86_400)], "step": ["6h"]})
    rows = [(r["metric"]["event_type"], int(t * 1000), float(v)) for r in body["data"]["result"] for t, v in r["values"]]
    return spark.createDataFrame(rows, "event_type string, step long, value double").withColumn("value", F.round("value", 4))


def i3_bare_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instant query of a bare range selector: the samples themselves."""
    found = Engine(_store(spark, sf_dir).source(CUT - 86_400_000, CUT)).instant_query('ev{event_type!="click"}[1d]', CUT)
    rows = [(r["metric"]["event_type"], int(round(t * 1000)), float(v)) for r in found["result"] for t, v in r["values"]]
    return spark.createDataFrame(rows, "event_type string, ts long, value double").withColumn("value", F.round("value", 6))


def o1_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sort_desc of an instant query, with the place of each row in the answer."""
    found = Engine(_store(spark, sf_dir).source(CUT - 86_400_000, CUT)).instant_query("sort_desc(sum_over_time(ev[1d]))", CUT)
    rows = [(i, r["metric"]["event_type"], float(r["value"][1])) for i, r in enumerate(found["result"])]
    return spark.createDataFrame(rows, "place long, event_type string, value double").withColumn("value", F.round("value", 4))


def r1_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel's grid: a value or null for each series and step."""
    start, step, n = CUT, 1_800_000, 48
    rows = derived.events(spark, sf_dir).where(f"t > {start - step} AND t <= {start + (n - 1) * step}")
    sums = rows.groupBy(F.create_map(F.lit("event_type"), "event_type").alias("labels"), (F.ceil((F.col("t") - start) / step) * step + start).cast("long").alias("step")).agg(F.sum("value").alias("value"))
    grid = panels.align(sums.where("step % 3600000 = 0"), start, start + (n - 1) * step, step)
    return grid.select(F.col("labels")["event_type"].alias("event_type"), F.posexplode("values").alias("slot", "value")).select("event_type", F.col("slot").cast("long").alias("slot"), F.round("value", 4).alias("value"))


def st1_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped texts made into samples with the target's labels, and the health series (ST2)."""
    rows = derived.events(spark, sf_dir)
    scrapes = rows.groupBy("event_type").agg(F.max("t").alias("ts"))
    lines = rows.select("event_type", F.concat(F.lit('ev{job="'), "event_type", F.lit('",id="'), F.col("event_id").cast("string"), F.lit('"} '), F.col("value").cast("string")).alias("line"))
    text = lines.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
    full = scrapes.join(text, "event_type").select(F.lit("own").alias("job"), F.col("event_type").alias("instance"), "ts", F.lit(True).alias("up"), F.lit(0.5).alias("duration_seconds"), "text")
    found = samples_of(full)
    column = lambda c: F.col("labels")[c].alias(c)
    return found.select(F.col("labels")[NAME].alias("name"), column("job"), column("instance"), column("exported_job"), column("id"), F.col("ts").cast("long").alias("ts"), F.round("value", 6).alias("value"))


def u2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregate ``tsdb_pack`` and the table function ``tsdb_batch``, by SQL."""
    codecs.register(spark)
    rows = derived.events(spark, sf_dir).groupBy("event_type", F.col("t").alias("ts")).agg(F.max_by("value", "event_id").alias("value"))
    name = f"points_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    blocks = spark.sql(f"SELECT event_type, ts - ts % 86400000 AS day, tsdb_pack(ts, value) AS payload FROM {name} GROUP BY ALL")
    return codecs.unpack(blocks, ["event_type"]).select("event_type", "ts", F.round("value", 6).alias("value"))


def u3_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary batches of a day's samples, read back by the table function ``tsdb_batch``."""
    codecs.register(spark)
    encode = F.udf(lambda rows: codecs.encode_batch([tuple(r) for r in rows]), "binary")
    rows = derived.events(spark, sf_dir).select((F.col("t") - F.col("t") % 86_400_000).alias("day"), F.struct("event_id", "t", "value").alias("r"))
    name = f"batches_{uuid.uuid4().hex}"
    rows.groupBy("day").agg(encode(F.collect_list("r")).alias("batch")).createOrReplaceTempView(name)
    return spark.sql(f"SELECT b.series_id, b.ts, round(b.value, 6) AS value FROM {name}, LATERAL tsdb_batch(batch) AS b")


def d10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir).stats(LATER)
    return spark.createDataFrame([(s["seriesCount"], s["sampleCount"], s["oldestSampleMs"], s["newestSampleMs"], s["samplesLastHour"])], "series_count long, sample_count long, oldest long, newest long, last_hour long")


def d13_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).rollup()


def sc6_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.events(spark, sf_dir)
    labels = F.create_map(F.lit(NAME), F.lit("ev"), F.lit("event_type"), "event_type", F.lit("id"), F.col("event_id").cast("string"))
    parsed = parse_lines(render_lines(rows.select(labels.alias("labels"), "value")))
    return parsed.select("name", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["id"].alias("id"), F.round("value", 6).alias("value"))


def cd2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.events(spark, sf_dir).groupBy("event_type", F.col("t").alias("ts")).agg(F.max_by("value", "event_id").alias("value"))
    return codecs.unpack(codecs.pack(rows, ["event_type"]), ["event_type"]).select("event_type", "ts", F.round("value", 6).alias("value"))


_QUERIES = (sk1_upsert, sk2_import, sk3_changes, sk5_log_replay, sk7_export, sc1_select, sc2_select_at_steps, d1_series_matching, d2_label_names, d3_label_values, d4_delete_before, d5_delete_batches, d7_compaction, d10_stats, d11_quick_stats, d12_count_samples, d13_rollup, d16_migration, sc10_export_samples, h2_query_range, h3_series, i3_bare_range, o1_sorted, r1_align, st1_samples, sc6_exposition, cd2_blocks, u2_pack, u3_batch)

_BASE = """WITH ev AS (SELECT event_id, event_type, value, epoch_ms(ts) AS t FROM events),
a AS (SELECT event_type, t - t % 60000 AS ts, event_id, value FROM ev),
b AS (SELECT event_type, ts + 60000 * (event_id % 2) AS ts, event_id, value + 1000 AS value FROM a WHERE event_id % 3 = 0),
a1 AS (SELECT event_type, ts, arg_max(value, event_id) AS value FROM a GROUP BY ALL),
b1 AS (SELECT event_type, ts, arg_max(value, event_id) AS value FROM b GROUP BY ALL),
up AS (SELECT event_type, ts, coalesce(b1.value, a1.value) AS value FROM a1 FULL JOIN b1 USING (event_type, ts)) """
_ROWS = "SELECT event_type, ts, round(value, 6) AS value FROM "


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    bucket = LATER - LATER % 21_600_000
    return {
        "sk1_upsert": _BASE + _ROWS + "up",
        "sk2_import": _BASE + "SELECT event_type, ts, round(coalesce(a1.value, b1.value), 6) AS value FROM a1 FULL JOIN b1 USING (event_type, ts)",
        "sk3_changes": _BASE + "SELECT ts, count(*) AS sample_count FROM b1 ANTI JOIN a1 USING (event_type, ts) GROUP BY ts",
        "sk5_log_replay": _BASE + "SELECT event_type, ts, round(coalesce(c1.value, up.value), 6) AS value FROM up LEFT JOIN (SELECT event_type, ts, arg_max(value, event_id) AS value FROM a WHERE event_id % 6 = 1 GROUP BY ALL) AS c1 USING (event_type, ts)",
        "sk7_export": _BASE + _ROWS + f"a1 WHERE event_type LIKE 'c%' AND ts BETWEEN {CUT} AND {LATER}",
        "sc1_select": _BASE + _ROWS + f"up WHERE event_type <> 'click' AND ts BETWEEN {CUT} AND {LATER}",
        "sc2_select_at_steps": _BASE + f"SELECT DISTINCT event_type, ts, round(value, 6) AS value FROM (SELECT e, event_type, max(ts) AS ts, arg_max(value, ts) AS value FROM a1 JOIN (SELECT unnest(range({CUT}, {LATER + 1}, 21600000)) AS e) ON ts > e - 3600000 AND ts <= e GROUP BY e, event_type)",
        "d1_series_matching": _BASE + f"SELECT DISTINCT event_type FROM a1 WHERE event_type LIKE '%c%' AND ts BETWEEN {CUT} AND {CUT + 3_600_000}",
        "d2_label_names": "SELECT unnest(['__name__', 'event_type']) AS name",
        "d3_label_values": "SELECT DISTINCT event_type AS value FROM events",
        "d4_delete_before": _BASE + _ROWS + f"up WHERE ts >= {LATER}",
        "d5_delete_batches": _BASE + _ROWS + f"a1 WHERE ts >= {bucket}",
        "d7_compaction": _BASE + _ROWS + "up",
        "d10_stats": _BASE + f"SELECT count(DISTINCT event_type) AS series_count, count(*) AS sample_count, min(ts) AS oldest, max(ts) AS newest, count(*) FILTER (WHERE ts >= {LATER - 3_600_000}) AS last_hour FROM a1",
        "d11_quick_stats": _BASE + f", live AS (SELECT event_type, ts FROM up WHERE ts >= {LATER} UNION SELECT event_type, ts FROM a WHERE ts < {CUT} AND event_id % 7 = 0) SELECT count(DISTINCT event_type) AS series_count, count(*) AS sample_count, min(ts) AS oldest, max(ts) AS newest FROM live",
        "d12_count_samples": _BASE + "SELECT count(*) AS n FROM up",
        "d16_migration": _BASE + "SELECT event_type, ts, CASE WHEN b1.value IS NULL THEN round(up.value, 6) ELSE 0.5 END AS value FROM up LEFT JOIN b1 USING (event_type, ts)",
        "sc10_export_samples": _BASE + _ROWS + "up",
        "h2_query_range": _BASE + f"SELECT event_type, e AS step, round(sum(value), 4) AS value FROM a1 JOIN (SELECT unnest(range({CUT}, {CUT + 5 * 86_400_000 + 1}, 21600000)) AS e) ON ts > e - 25200000 AND ts <= e - 3600000 GROUP BY e, event_type",
        "h3_series": _BASE + f"SELECT DISTINCT 'ev' AS name, event_type FROM a1 WHERE event_type LIKE '%c%' AND ts BETWEEN {CUT} AND {LATER}",
        "i3_bare_range": _BASE + _ROWS + f"a1 WHERE event_type <> 'click' AND ts > {CUT - 86_400_000} AND ts <= {CUT}",
        "o1_sorted": _BASE + f"SELECT row_number() OVER (ORDER BY v DESC) - 1 AS place, event_type, round(v, 4) AS value FROM (SELECT event_type, sum(value) AS v FROM a1 WHERE ts > {CUT - 86_400_000} AND ts <= {CUT} GROUP BY 1)",
        "r1_align": _BASE + f", s AS (SELECT event_type, CAST(ceil((t - {CUT}) / 1800000.0) AS BIGINT) AS slot, sum(value) AS v FROM ev WHERE t > {CUT - 1_800_000} AND t <= {CUT + 47 * 1_800_000} GROUP BY ALL), w AS (SELECT * FROM s WHERE slot % 2 = 0) SELECT event_type, slot, round(v, 4) AS value FROM (SELECT DISTINCT event_type FROM w) CROSS JOIN (SELECT unnest(range(48)) AS slot) LEFT JOIN w USING (event_type, slot)",
        "st1_samples": _BASE + ", last AS (SELECT event_type, max(t) AS ts, count(*) AS n FROM ev GROUP BY 1) SELECT 'ev' AS name, 'own' AS job, event_type AS instance, event_type AS exported_job, CAST(event_id AS VARCHAR) AS id, last.ts AS ts, round(value, 6) AS value FROM ev JOIN last USING (event_type) UNION ALL SELECT unnest(['up', 'scrape_duration_seconds', 'scrape_samples_scraped']), 'own', event_type, NULL, NULL, ts, unnest([1.0, 0.5, CAST(n AS DOUBLE)]) FROM last",
        "u2_pack": "SELECT event_type, epoch_ms(ts) AS ts, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2",
        "u3_batch": "SELECT event_id AS series_id, epoch_ms(ts) AS ts, round(value, 6) AS value FROM events",
        "d13_rollup": _BASE + "SELECT ts AS bucket_ms, count(*) AS sample_count FROM a1 GROUP BY ts",
        "sc6_exposition": "SELECT 'ev' AS name, event_type, CAST(event_id AS VARCHAR) AS id, round(value, 6) AS value FROM events",
        "cd2_blocks": "SELECT event_type, epoch_ms(ts) AS ts, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2",
    }
