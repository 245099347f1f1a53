"""A sample store of Parquet directories under a manifest.

Writes append directories of one batch each, split by buckets of time (six hours
by default); reads take the last write of each series and millisecond. A manifest
names the directories that count, with the exact number, first and last time of the live samples of each
bucket. A change becomes visible when its manifest is
renamed into place. Directories have random names, so what a failed write
leaves is never met again, and ``vacuum`` removes it. There is one writer at a time: the test
for another one's manifest isn't atomic on every file system.

Compaction merges a bucket's directories into one, sorted by series and time,
which is then read without any merging. Beside the samples of a bucket lie the ids of
its series, so that retention finds series without samples in a number of rows that follows series, not samples. Buckets outside a query's time range
are left out on the driver, within a bucket Parquet's statistics apply. Deleting
before a time is a change of the manifest alone: whole buckets go, and the
directories of the bucket that the time falls in get a lower bound, which reads apply.

All paths go through Hadoop's file systems, so the store can be wherever Spark can read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.syntax import Matcher
from ..plans.values import Source, canonical, matches

BUCKET_MS = 21_600_000
MINUTE_MS = 60_000
HOUR_MS = 3_600_000
SAMPLE = "sid long, ts long, value double, seq long"
SERIES = "sid long, labels_key string, labels map<string,string>"
FORMAT, LAYOUT = "sample-store", 2
#: Series up to which the driver keeps the labels of a version (a checked bound; more are joined as a table).
FEW_SERIES = 10_000
#: Series up to which their ids, eight bytes each, are broadcast to the scan of the samples.
BROADCAST_IDS = 1_000_000


class StoreError(RuntimeError):
    pass


@dataclass
class Part:
    """A directory of a bucket; samples before ``since`` don't count. ``ids``: the directory of the ids of its series."""

    path: str
    size: int
    since: int | None = None
    ids: str | None = None


@dataclass
class Bucket:
    parts: list[Part] = field(default_factory=list)
    #: Of the live samples, exactly.
    count: int = 0
    first: int | None = None
    last: int | None = None
    #: One directory without rows to merge.
    merged: bool = False

    def add(self, count: int, first: int | None, last: int | None) -> None:
        self.count += count
        self.first = min((x for x in (self.first, first) if x is not None), default=None)
        self.last = max((x for x in (self.last, last) if x is not None), default=None)


@dataclass
class Manifest:
    version: int = 0
    seq: int = 0
    bucket_ms: int = BUCKET_MS
    series: list[str] = field(default_factory=list)
    series_count: int = 0
    #: bucket start -> what it holds
    buckets: dict[int, Bucket] = field(default_factory=dict)

    def text(self) -> str:
        buckets = {str(k): [[[p.path, p.size, p.since, p.ids] for p in b.parts], b.count, b.first, b.last, b.merged] for k, b in sorted(self.buckets.items())}
        return json.dumps({"format": FORMAT, "layout": LAYOUT, "version": self.version, "seq": self.seq, "bucket_ms": self.bucket_ms, "series": self.series, "series_count": self.series_count, "buckets": buckets})

    @staticmethod
    def of(text: str) -> Manifest:
        raw = json.loads(text)
        if raw.get("format") != FORMAT or raw.get("layout") != LAYOUT:
            raise StoreError(f"not a store of layout {LAYOUT}: it says {raw.get('format')!r}, {raw.get('layout')!r}")
        buckets = {int(k): Bucket([Part(*p) for p in parts], *more) for k, (parts, *more) in raw["buckets"].items()}
        return Manifest(raw["version"], raw["seq"], raw["bucket_ms"], raw["series"], raw["series_count"], buckets)


class MetricStore:
    """``bucket_ms``: the span of a bucket, fixed by the first write; ``rows_per_file``: about how many samples a file of a bucket holds."""

    def __init__(self, spark: SparkSession, path: str, bucket_ms: int | None = None, rows_per_file: int = 4_000_000):
        for name, value in (("bucket_ms", bucket_ms or 1), ("rows_per_file", rows_per_file)):
            if not isinstance(value, int) or value <= 0:
                raise StoreError(f"{name} must be a positive whole number")
        self.spark, self.path, self.rows_per_file = spark, path.rstrip("/"), rows_per_file
        jvm = spark._jvm
        self._Path, self._to_text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils.toString
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._labels: tuple[list[str], DataFrame] | None = None
        #: Whether a manifest couldn't be read and an older one is in use; then the recovery log is worth replaying.
        self.recovered = False
        found = self.manifest()
        if bucket_ms and found.version and found.bucket_ms != bucket_ms:
            raise StoreError(f"the store has buckets of {found.bucket_ms} ms")
        self.bucket_ms = found.bucket_ms if found.version else bucket_ms or BUCKET_MS

    # Manifests

    def _manifests(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._list("manifest") if n.endswith(".json") and not n.startswith("."))

    def manifest(self) -> Manifest:
        """The newest that can be read."""
        versions = self._manifests()
        for i, version in enumerate(reversed(versions)):
            stream = self._fs.open(self._Path(f"{self.path}/manifest/{version:012d}.json"))
            try:
                found = Manifest.of(self._to_text(stream, "UTF-8"))
            except (ValueError, KeyError, TypeError):
                self.recovered = True
                continue
            finally:
                stream.close()
            found.version = versions[-1] if i else found.version  # the next one comes after those that are broken
            return found
        if versions:
            raise StoreError("no manifest can be read")
        return Manifest(bucket_ms=getattr(self, "bucket_ms", BUCKET_MS))

    def _commit(self, m: Manifest) -> None:
        m.version += 1
        final = self._Path(f"{self.path}/manifest/{m.version:012d}.json")
        draft = self._Path(f"{self.path}/manifest/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(m.text().encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise StoreError("another writer has changed the store; try again")

    # Reading

    def series(self, m: Manifest | None = None) -> DataFrame:
        """(sid, labels_key, labels). A few series are kept on the driver, so that planning can match them without a job."""
        m = m or self.manifest()
        if not m.series:
            return self.spark.createDataFrame([], SERIES)
        if self._labels and self._labels[0] == m.series:
            return self._labels[1]
        found = self.spark.read.schema(SERIES).parquet(*[f"{self.path}/{d}" for d in m.series])
        if m.series_count <= FEW_SERIES:
            rows = found.toArrow()
            found = self.spark.createDataFrame(rows, found.schema) if isinstance(rows, pa.Table) and rows.num_rows else found
            self._labels = m.series, found
        return found

    def _rows(self, buckets: dict[int, Bucket], start: int | None, end: int | None) -> DataFrame | None:
        """(sid, ts, value, seq) of all directories, overwritten samples included."""
        by_bound: dict[int | None, list[str]] = {}
        for b in buckets.values():
            for p in b.parts:
                by_bound.setdefault(p.since, []).append(f"{self.path}/{p.path}")
        parts = []
        for since, paths in by_bound.items():
            df = self.spark.read.schema(SAMPLE).parquet(*paths)
            low = max((x for x in (start, since) if x is not None), default=None)
            df = df if low is None else df.where(F.col("ts") >= low)
            parts.append(df if end is None else df.where(F.col("ts") <= end))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def samples(self, start: int | None = None, end: int | None = None, m: Manifest | None = None) -> DataFrame:
        """(sid, ts, value) with start <= ts <= end; the last write of a series and millisecond wins."""
        m = m or self.manifest()
        live = {k: b for k, b in m.buckets.items() if b.count and (end is None or b.first <= end) and (start is None or b.last >= start)}
        parts = []
        merged = self._rows({k: b for k, b in live.items() if b.merged}, start, end)
        if merged is not None:
            parts.append(merged.select("sid", "ts", "value"))
        raw = self._rows({k: b for k, b in live.items() if not b.merged}, start, end)
        if raw is not None:
            # Dealt by series and bucket, so that the samples of both come out in order.
            dealt = raw.withColumn("bucket", self._bucket()).repartition("sid", "bucket")
            parts.append(dealt.groupBy("sid", "bucket", "ts").agg(F.max_by("value", "seq").alias("value")).sortWithinPartitions("sid", "ts").select("sid", "ts", "value"))
        if not parts:
            return self.spark.createDataFrame([], "sid long, ts long, value double")
        return reduce(DataFrame.unionByName, parts)

    def source(self, start: int | None = None, end: int | None = None) -> Source:
        """For the query engine; give the time range of the queries to leave out buckets."""
        m = self.manifest()
        return Source(self.series(m).select("sid", "labels"), self.samples(start, end, m), in_order=m.series_count <= BROADCAST_IDS)

    def select(self, matchers: tuple[Matcher, ...], start: int, end: int) -> DataFrame:
        """(labels, sid, ts, value) of matching series in [start, end]."""
        m = self.manifest()
        series = self.series(m).where(matches(F.col("labels"), matchers)).select("sid", "labels")
        rows = self.samples(start, end, m)
        if m.series_count <= FEW_SERIES:  # ids reach the scan, where statistics skip other series
            rows = rows.where(F.col("sid").isin([r.sid for r in series.select("sid").collect()]))
            series = F.broadcast(series)
        return rows.join(series, "sid").select("labels", "sid", "ts", "value")

    def select_at_steps(self, matchers: tuple[Matcher, ...], start: int, end: int, step: int, lookback: int) -> DataFrame:
        """As ``select``, but only samples that are the latest visible one at a step at least."""
        from ..operators.selectors import instant
        from ..plans.syntax import Selector
        from ..plans.values import Grid

        first = start - lookback
        rows = self.samples(first, end)
        grid = Grid(start, step, (end - start) // step + 1)
        stamped = Source(self.series().select("sid", "labels"), rows.select("sid", "ts", F.col("ts").cast("double").alias("value")))
        seen = instant(stamped, Selector(matchers), grid, lookback).data.select("sid", F.col("value").cast("long").alias("ts")).distinct()
        return rows.join(seen, ["sid", "ts"]).join(self.series_matching(matchers), "sid").select("labels", "sid", "ts", "value")

    def series_matching(self, matchers: tuple[Matcher, ...] = (), start: int | None = None, end: int | None = None) -> DataFrame:
        """(sid, labels); with bounds only series that have a sample between them."""
        out = self.series().where(matches(F.col("labels"), matchers)).select("sid", "labels")
        if start is None and end is None:
            return out
        return out.join(self.samples(start, end).select("sid"), "sid", "left_semi")

    def label_names(self, matchers: tuple[Matcher, ...] = ()) -> DataFrame:
        return self.series_matching(matchers).select(F.explode(F.map_keys("labels")).alias("name")).distinct().orderBy("name")

    def label_values(self, name: str, matchers: tuple[Matcher, ...] = ()) -> DataFrame:
        return self.series_matching(matchers).select(F.col("labels")[name].alias("value")).where("value is not null").distinct().orderBy("value")

    # Writing

    def ingest(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """Upserts ``(labels, ts, value)``; of equal series and times the last row wins. Returns new samples per time."""
        return self._write(rows, order, overwrite=True)

    def import_samples(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """As ``ingest``, but samples that exist already stay as they are."""
        return self._write(rows, order, overwrite=False)

    def _write(self, rows: DataFrame, order: str | None, overwrite: bool) -> DataFrame:
        m = self.manifest()
        m.seq += 1
        name = uuid.uuid4().hex
        fine = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("ts").isNotNull() & ~F.isnan(F.col("ts").cast("double")) & (F.abs(F.col("ts").cast("double")) < 2.0**53))
        place = F.col(order) if order else F.monotonically_increasing_id()
        named = fine.select("labels", canonical(F.col("labels")).alias("labels_key"), F.floor(F.col("ts").cast("double") + 0.5).cast("long").alias("ts"), F.col("value").cast("double").alias("value"), place.alias("__place")).where("ts >= 0")
        named = named.withColumn("sid", F.xxhash64("labels_key"))
        once = named.groupBy("sid", "ts").agg(F.max_by("value", "__place").alias("value"), F.first("labels_key").alias("labels_key"), F.first("labels").alias("labels"))
        # The batch is written once; all that follows reads it back.
        once.write.parquet(f"{self.path}/batch/{name}")
        batch = self.spark.read.schema("sid long, ts long, value double, labels_key string, labels map<string,string>").parquet(f"{self.path}/batch/{name}")
        bounds = batch.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
        if bounds.a is None:
            self._delete(f"batch/{name}")
            return self.spark.createDataFrame([], "ts long, sample_count long")
        existing = self.samples(bounds.a, bounds.b, m).select("sid", "ts").withColumn("old", F.lit(True))
        marked = batch.join(existing, ["sid", "ts"], "left") if m.buckets else batch.withColumn("old", F.lit(None).cast("boolean"))
        changes = marked.where("old is null").groupBy("ts").agg(F.count(F.lit(1)).alias("sample_count"))
        changes.write.parquet(f"{self.path}/changes/{name}")
        changes = self.spark.read.schema("ts long, sample_count long").parquet(f"{self.path}/changes/{name}")
        self._add_series(batch, m, name)
        out = batch if overwrite else marked.where("old is null")
        sizes = {r.bucket: r.n for r in out.groupBy(self._bucket()).agg(F.count(F.lit(1)).alias("n")).collect()}
        written = self._write_buckets(out.select("sid", "ts", "value", F.lit(m.seq).alias("seq")), name, sizes)
        for k, part in written.items():
            bucket = m.buckets.setdefault(k, Bucket(merged=True))
            bucket.merged = not bucket.parts and bucket.merged
            bucket.parts.append(part)
        for r in changes.groupBy(self._bucket()).agg(F.sum("sample_count").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).collect():  # a row a bucket
            m.buckets[r.bucket].add(r.n, r.a, r.b)
        self._commit(m)
        self._delete(f"batch/{name}")
        return changes

    def _bucket(self) -> Column:
        return (F.col("ts") - F.col("ts") % self.bucket_ms).alias("bucket")

    def _write_buckets(self, rows: DataFrame, name: str, sizes: dict[int, int]) -> dict[int, Part]:
        """Writes (sid, ts, value, seq) by bucket, each bucket in files of about ``rows_per_file`` rows, sorted."""
        files = {k: -(-n // self.rows_per_file) for k, n in sizes.items() if n > self.rows_per_file}
        shard = F.lit(0)
        if files:
            of = F.create_map(*[F.lit(x) for pair in files.items() for x in pair])
            shard = F.pmod("sid", F.coalesce(of[F.col("bucket")], F.lit(1)))
        spread = rows.withColumn("bucket", self._bucket()).repartition("bucket", shard)
        spread.sortWithinPartitions("bucket", "sid", "ts").write.partitionBy("bucket").parquet(f"{self.path}/samples/{name}")
        # The ids of each bucket's series, from the column just written: what retention reads instead of samples.
        ids = self.spark.read.schema("sid long, bucket long").parquet(f"{self.path}/samples/{name}").select("bucket", "sid").distinct()
        ids.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/ids/{name}")
        made = {}
        for status in self._fs.listStatus(self._Path(f"{self.path}/samples/{name}")):
            inner = status.getPath().getName()
            if inner.startswith("bucket="):
                made[int(inner[7:])] = Part(f"samples/{name}/{inner}", self._fs.getContentSummary(status.getPath()).getLength(), ids=f"ids/{name}/{inner}")
        return made

    def _add_series(self, batch: DataFrame, m: Manifest, name: str) -> None:
        known = self.series(m)
        new = batch.groupBy("sid").agg(F.min("labels_key").alias("labels_key"), F.max("labels_key").alias("other"), F.first("labels").alias("labels"))
        beside = new.join(known.select("sid", F.col("labels_key").alias("theirs")), "sid", "left")
        found = beside.agg(F.count_if(F.expr("labels_key <> other or labels_key <> theirs")).alias("clash"), F.count_if(F.expr("theirs is null")).alias("fresh")).first()
        if found.clash:
            raise StoreError("two series have the same id")
        if found.fresh:
            beside.where("theirs is null").select("sid", "labels_key", "labels").write.parquet(f"{self.path}/series/{name}")
            m.series = [*m.series, f"series/{name}"]
            m.series_count += found.fresh

    def _list(self, name: str) -> list[str]:
        path = self._Path(f"{self.path}/{name}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _delete(self, name: str) -> None:
        self._fs.delete(self._Path(f"{self.path}/{name}"), True)

    # Maintenance

    def _rewrite(self, m: Manifest, buckets: list[int]) -> None:
        """Buckets merged into a directory each."""
        if not buckets:
            return
        m.seq += 1
        part = Manifest(m.version, m.seq, m.bucket_ms, m.series, m.series_count, {b: m.buckets[b] for b in buckets})
        rows = self.samples(None, None, part).select("sid", "ts", "value", F.lit(m.seq).alias("seq"))
        written = self._write_buckets(rows, uuid.uuid4().hex, {b: m.buckets[b].count for b in buckets})
        for b in buckets:
            if b in written:
                m.buckets[b].parts, m.buckets[b].merged = [written[b]], True
            else:
                del m.buckets[b]

    def compact_before(self, cutoff: int, max_buckets: int | None = None, max_samples: int | None = None) -> dict:
        """Merges whole buckets before the cutoff, the oldest first; one at least."""
        m = self.manifest()
        aligned = cutoff - cutoff % self.bucket_ms
        open_ = sorted(b for b in m.buckets if b < aligned and (not m.buckets[b].merged or m.buckets[b].parts[0].since is not None))
        now, points = open_[:max_buckets], 0
        for i, b in enumerate(now):
            points += m.buckets[b].count
            if max_samples is not None and points >= max_samples:
                now = now[: i + 1]
                break
        self._rewrite(m, now)
        if now:
            self._commit(m)
        rest = [m.buckets[b].first for b in open_[len(now) :]]
        return {"complete": not rest, "cutoffMs": aligned, "compactedBuckets": len(now), "compactedPoints": points, "oldestUncompactedMs": min(rest, default=None)}

    def delete_before(self, cutoff: int) -> int:
        """Removes samples with ts < cutoff exactly, and series left without any; the number of samples removed."""
        m = self.manifest()
        gone = 0
        for k in [k for k, b in m.buckets.items() if b.last is None or b.last < cutoff]:
            gone += m.buckets.pop(k).count
        for b in [b for b in m.buckets.values() if b.first < cutoff]:  # one: that of the cutoff
            for p in b.parts:
                p.since = max(cutoff, p.since or 0)
            left = self.samples(m=Manifest(buckets={0: b})).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a")).first()
            gone += b.count - left.n
            b.count, b.first = left.n, left.a
        self._prune(m)
        self._commit(m)
        return gone

    def delete_before_batch(self, cutoff: int, max_samples: int) -> dict:
        """Removes whole buckets before the aligned cutoff, the oldest first, until ``max_samples`` are gone; one at least."""
        m = self.manifest()
        aligned = cutoff - cutoff % self.bucket_ms
        gone, old = 0, sorted(b for b in m.buckets if b < aligned)
        while old and (gone == 0 or gone < max_samples):
            gone += m.buckets.pop(old.pop(0)).count
        self._commit(m)
        return {"complete": not old, "cutoffMs": aligned, "deletedSamples": gone}

    def finalize_retention(self) -> None:
        """Prunes series without samples; may be repeated."""
        m = self.manifest()
        self._prune(m)
        self._commit(m)

    def _prune(self, m: Manifest) -> None:
        """Reads the ids of each bucket's series, and only of directories that a time cuts the ids of the samples left."""
        whole = [f"{self.path}/{p.ids}" for b in m.buckets.values() for p in b.parts if p.ids and p.since is None]
        cut = {k: Bucket([p for p in b.parts if not p.ids or p.since is not None]) for k, b in m.buckets.items()}
        rows = self._rows(cut, None, None)
        found = [self.spark.read.schema("sid long").parquet(*whole)] if whole else []
        found += [] if rows is None else [rows.select("sid")]
        left = reduce(DataFrame.unionByName, found).distinct() if found else self.spark.createDataFrame([], "sid long")
        n = left.count()
        if n < m.series_count:
            name = f"series/{uuid.uuid4().hex}"
            files = -(-max(1, n) // self.rows_per_file)
            self.series(m).join(left, "sid", "left_semi").repartition(files).write.parquet(f"{self.path}/{name}")
            m.series, m.series_count = [name], n

    def vacuum(self) -> int:
        """Deletes directories that the newest manifest doesn't name, returned changes, and other manifests; the number of directories.

        Nothing may be writing meanwhile.
        """
        m = self.manifest()
        live = {d for b in m.buckets.values() for p in b.parts for d in (p.path, p.ids)} | set(m.series)
        dead = [f"series/{n}" for n in self._list("series") if f"series/{n}" not in live]
        for place in [f"{kind}/{n}" for kind in ("samples", "ids") for n in self._list(kind)]:
            own = [f"{place}/{b}" for b in self._list(place) if b.startswith("bucket=")]
            dead += [d for d in own if d not in live] if any(d in live for d in own) else [place]
        dead += [f"{kind}/{n}" for kind in ("batch", "changes") for n in self._list(kind)]
        newest = f"{self._manifests()[-1]:012d}.json" if self._manifests() else ""
        for name in [*dead, *[f"manifest/{n}" for n in self._list("manifest") if n != newest and not n.endswith(".crc")]]:
            self._delete(name)
        return len(dead)

    # Statistics

    def quick_stats(self, now: int | None = None) -> dict:
        """From the manifest alone; samples of the last hour, by whole minutes, are read if ``now`` is given."""
        m = self.manifest()
        full = [b for b in m.buckets.values() if b.count]
        hour = None if now is None else self.samples((now - HOUR_MS) // MINUTE_MS * MINUTE_MS, None, m).count()
        size = sum(p.size for b in m.buckets.values() for p in b.parts)
        return {"seriesCount": m.series_count, "sampleCount": sum(b.count for b in full), "oldestSampleMs": min((b.first for b in full), default=None), "newestSampleMs": max((b.last for b in full), default=None), "sizeBytes": size, "samplesLastHour": hour}

    def stats(self, now: int) -> dict:
        """As ``quick_stats``, whose numbers are exact; the last hour by the millisecond."""
        return self.quick_stats() | {"samplesLastHour": self.samples(now - HOUR_MS).count()}

    def count_samples(self) -> int:
        return self.quick_stats()["sampleCount"]

    def rollup(self) -> DataFrame:
        """Samples per minute."""
        return self.samples().groupBy((F.col("ts") - F.col("ts") % MINUTE_MS).alias("bucket_ms")).agg(F.count(F.lit(1)).alias("sample_count"))

    # Export

    def export_samples(self) -> DataFrame:
        """(labels, ts, value), by series and time."""
        return self.samples().join(self.series().select("sid", "labels"), "sid").orderBy("sid", "ts").select("labels", "ts", "value")

    def export_lines(self, selectors: list[tuple[Matcher, ...]], start: int = 0, end: int = 2**53) -> DataFrame:
        """A JSON line for each series and selector, by day of samples so that no line is unbounded."""
        day = (F.col("ts") - F.col("ts") % 86_400_000).alias("day")
        lines = []
        for i, matchers in enumerate(selectors):
            each = self.select(matchers, start, end).groupBy("sid", day).agg(F.first("labels").alias("metric"), F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("p"))
            line = F.to_json(F.struct("metric", F.transform("p", lambda x: x["value"]).alias("values"), F.transform("p", lambda x: x["ts"]).alias("timestamps")))
            lines.append(each.select(F.lit(i).alias("selector"), "sid", "day", line.alias("value")))
        return reduce(DataFrame.unionByName, lines).orderBy("selector", "sid", "day").select("value")
