"""An in-process registry of counters, gauges, histograms and summaries, whose samples feed a DataFrame."""

from __future__ import annotations

import math
import time
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)
DEFAULT_PERCENTILES = (0.01, 0.05, 0.5, 0.9, 0.95, 0.99, 0.999)
#: What each kind of metric can do.
ABILITIES = {"counter": {"inc"}, "gauge": {"inc", "dec", "set", "time"}, "histogram": {"observe", "time"}, "summary": {"observe", "time"}}


@dataclass
class Metric:
    kind: str
    name: str
    help: str = ""
    label_names: tuple[str, ...] = ()
    buckets: tuple[float, ...] = DEFAULT_BUCKETS
    percentiles: tuple[float, ...] = DEFAULT_PERCENTILES
    values: dict[tuple[str, ...], list[float]] = field(default_factory=dict)

    def _able(self, ability: str) -> None:
        if ability not in ABILITIES[self.kind]:
            raise TypeError(f"a {self.kind} can't {ability}")

    def _key(self, labels: dict[str, object] | None) -> tuple[str, ...]:
        labels = labels or {}
        if odd := set(labels) - set(self.label_names):
            raise ValueError(f"unknown labels: {sorted(odd)}")
        return tuple(str(labels[n]) if n in labels else "" for n in self.label_names)

    def inc(self, by: float = 1, labels: dict | None = None) -> None:
        self._able("inc")
        if self.kind == "counter" and by < 0:
            raise ValueError("a counter can't decrease")
        self.values.setdefault(self._key(labels), [0.0])[0] += by

    def dec(self, by: float = 1, labels: dict | None = None) -> None:
        self._able("dec")
        self.inc(-by, labels)

    def set(self, value: float, labels: dict | None = None) -> None:
        self._able("set")
        self.values[self._key(labels)] = [float(value)]

    def observe(self, value: float, labels: dict | None = None) -> None:
        """A histogram keeps a count for each bucket and the sum; a summary, whose quantiles are exact, keeps the values."""
        self._able("observe")
        key, value = self._key(labels), float(value)
        if self.kind == "summary":
            self.values.setdefault(key, []).append(value)
            return
        kept = self.values.setdefault(key, [0.0] * (len(self.buckets) + 2))  # the counts, those beyond all bounds, the sum
        kept[bisect_left(self.buckets, value)] += 1
        kept[-1] += value

    def timer(self, labels: dict | None = None):
        """A function that, called, records the seconds since."""
        self._able("time")
        begin = time.perf_counter()

        def stop() -> float:
            seconds = time.perf_counter() - begin
            (self.set if self.kind == "gauge" else self.observe)(seconds, labels)
            return seconds

        return stop

    def clear(self) -> None:
        self.values.clear()

    def samples(self) -> list[tuple[str, dict[str, str], float]]:
        out = []
        for key, values in self.values.items():
            labels = {n: v for n, v in zip(self.label_names, key, strict=True) if v != ""}
            if self.kind in ("counter", "gauge"):
                out.append((self.name, labels, values[0]))
                continue
            if self.kind == "histogram":
                *counts, total = values
                for bound, n in zip([*self.buckets, math.inf], accumulate(counts), strict=True):
                    out.append((f"{self.name}_bucket", {**labels, "le": "+Inf" if math.isinf(bound) else f"{bound:g}"}, n))
                size = sum(counts)
            else:
                ordered = sorted(values)
                for p in self.percentiles:
                    out.append((self.name, {**labels, "quantile": f"{p:g}"}, ordered[min(len(ordered) - 1, int(p * len(ordered)))] if ordered else 0.0))
                size, total = float(len(values)), sum(values)
            out += [(f"{self.name}_sum", labels, total), (f"{self.name}_count", labels, size)]
        return out


class Registry:
    def __init__(self, prefix: str = "", default_labels: dict[str, str] | None = None):
        self.prefix, self.default_labels, self.metrics = prefix, default_labels or {}, {}

    def _create(self, kind: str, name: str, help: str, labels: tuple[str, ...], **more) -> Metric:
        """The metric of that name; a second call gives the same one."""
        return self.metrics.setdefault(self.prefix + name, Metric(kind, self.prefix + name, help, tuple(labels), **more))

    def counter(self, name: str, help: str = "", labels: tuple[str, ...] = ()) -> Metric:
        return self._create("counter", name, help, labels)

    def gauge(self, name: str, help: str = "", labels: tuple[str, ...] = ()) -> Metric:
        return self._create("gauge", name, help, labels)

    def histogram(self, name: str, help: str = "", labels: tuple[str, ...] = (), buckets: tuple[float, ...] = DEFAULT_BUCKETS) -> Metric:
        return self._create("histogram", name, help, labels, buckets=tuple(buckets))

    def summary(self, name: str, help: str = "", labels: tuple[str, ...] = (), percentiles: tuple[float, ...] = DEFAULT_PERCENTILES) -> Metric:
        return self._create("summary", name, help, labels, percentiles=tuple(percentiles))

    def clear(self) -> None:
        for metric in self.metrics.values():
            metric.clear()

    def remove(self, name: str) -> bool:
        return self.metrics.pop(self.prefix + name, None) is not None

    def collect(self) -> list[tuple[str, dict[str, str], float]]:
        return [(n, {**self.default_labels, **labels}, v) for m in self.metrics.values() for n, labels, v in m.samples()]

    def frame(self, spark: SparkSession) -> DataFrame:
        """name, labels, value and timestamp_ms, as a parsed scrape has them."""
        rows = [(n, labels, v, None) for n, labels, v in self.collect()]
        return spark.createDataFrame(rows, "name string, labels map<string,string>, value double, timestamp_ms long")

    def text(self) -> str:
        lines = []
        for m in self.metrics.values():
            lines += [f"# HELP {m.name} {m.help}", f"# TYPE {m.name} {m.kind}"]
            for name, labels, v in m.samples():
                pairs = ",".join(f'{k}="{_escaped(x)}"' for k, x in {**self.default_labels, **labels}.items())
                lines.append(f"{name}{'{' + pairs + '}' if pairs else ''} {_number(v)}")
        return "\n".join(lines) + "\n"


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace('"', '\\"')


def _number(v: float) -> str:
    from ..engine import number_text

    return number_text(v)
