"""The text exposition format: parsing and writing, and samples built from it.

Lines are parsed by regular expressions in Spark. A malformed line is left out,
a number that can't be read is NaN.
"""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import INF, NAN
from ..plans.syntax import NAME
from ..plans.values import without_name

_LABEL = r'[a-zA-Z_][a-zA-Z0-9_]*="(?:[^"\\]|\\.)*"'
_LINE = rf"(?s)^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{{[ ,]*(?:{_LABEL}[ ,]*)*\}})?(.*)$"
_PAIR = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
#: Labels that a target sets itself; a sample's own are kept under another name.
TARGET_LABELS = ("job", "instance")


def _number(text: Column) -> Column:
    plain = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    special = F.when(text.isin("+Inf", "Inf", "Infinity", "+Infinity"), F.lit(INF)).when(text.isin("-Inf", "-Infinity"), F.lit(-INF))
    return F.coalesce(plain, special, F.lit(NAN))


def _unescaped(value: Column) -> Column:
    """Backslash escapes; pieces between doubled backslashes are treated alone."""
    parts = F.split(value, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"\\n", "\n"), r"\\(.)", "$1"))
    return F.array_join(plain, "\\")


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """The other columns, and name, labels, value and timestamp_ms of each sample line."""
    text = F.regexp_replace(F.col(line), r"^\s+|\s+$", "")
    rest = [c for c in lines.columns if c != line]
    rows = lines.select(*rest, text.alias("__line")).where((F.col("__line") != "") & ~F.col("__line").startswith("#"))
    rows = rows.select(*rest, *[F.regexp_extract("__line", _LINE, i).alias(n) for i, n in enumerate(("name", "__body", "__rest"), 1)])
    words = F.split(F.regexp_replace("__rest", r"^\s+", ""), r"\s+")
    rows = rows.withColumn("__words", words).where((F.col("name") != "") & (F.get("__words", F.lit(0)) != "") & ~F.col("__rest").startswith("{"))
    keys = F.regexp_extract_all("__body", F.lit(_PAIR), 1)
    values = F.transform(F.regexp_extract_all("__body", F.lit(_PAIR), 2), _unescaped)
    # Of a label given twice the last value counts.
    pairs = F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda p: F.array_position(F.slice(keys, p["i"] + 2, F.size(keys)), p["k"]) == 0)
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"].alias("key"), F.get(values, p["i"]).alias("value"))))
    stamp = _number(F.coalesce(F.get("__words", F.lit(1)), F.lit("NaN")))
    whole = F.when(~F.isnan(stamp) & (F.abs(stamp) < 2.0**63), F.floor(stamp + 0.5).cast("long"))
    return rows.select(*rest, "name", labels.alias("labels"), _number(F.get("__words", F.lit(0))).alias("value"), whole.alias("timestamp_ms"))


def read_exposition(texts: DataFrame, text: str = "text") -> DataFrame:
    """The samples of whole scrapes, a text each."""
    rest = [c for c in texts.columns if c != text]
    return parse_lines(texts.select(*rest, F.explode(F.split(F.col(text), "\n")).alias("value")))


def build_samples(parsed: DataFrame, job: Column, instance: Column, scrape_ms: Column) -> DataFrame:
    """(labels, ts, value) as stored: target labels added, clashing ones renamed, NaN dropped."""
    own = F.map_filter(F.transform_keys("labels", lambda k, _: F.when(k.isin(*TARGET_LABELS), F.concat(F.lit("exported_"), k)).otherwise(k)), lambda k, _: k != NAME)
    target = F.create_map(F.lit(NAME), F.col("name"), F.lit("job"), job, F.lit("instance"), instance)
    return parsed.where(~F.isnan("value")).select(F.map_concat(target, own).alias("labels"), F.coalesce("timestamp_ms", scrape_ms).alias("ts"), "value")


def health_samples(scrapes: DataFrame) -> DataFrame:
    """up, scrape_duration_seconds and scrape_samples_scraped of (job, instance, ts, up, duration_seconds, samples)."""
    values = F.map_from_arrays(F.array(*[F.lit(n) for n in ("up", "scrape_duration_seconds", "scrape_samples_scraped")]), F.array(F.col("up").cast("double"), F.col("duration_seconds").cast("double"), F.col("samples").cast("double")))
    rows = scrapes.select("job", "instance", "ts", F.explode(values).alias("name", "value"))
    return rows.select(F.create_map(F.lit(NAME), "name", F.lit("job"), "job", F.lit("instance"), "instance").alias("labels"), "ts", "value")


def instance_of(target: str) -> str:
    """Host and port of a target's URL; what isn't a URL stays as it is."""
    parts = urlsplit(target)
    return parts.netloc.rpartition("@")[2].lower() if parts.scheme and parts.netloc else target


def render_lines(samples: DataFrame) -> DataFrame:
    """A text line for each (labels, value)."""
    escaped = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), "\n", r"\\n"), '"', r'\\"')
    pairs = F.transform(F.array_sort(F.map_entries(without_name(F.col("labels")))), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    v = F.col("value")
    number = F.when(v == INF, F.lit("+Inf")).when(v == -INF, F.lit("-Inf")).when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("long").cast("string")).otherwise(v.cast("string"))
    body = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))
    return samples.select(F.concat(F.col("labels")[NAME], body, F.lit(" "), number).alias("value"))
