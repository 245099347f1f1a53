"""Panels: their configuration, aligned results, legends and number formats."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine, number_text
from ..plans.syntax import NAME, QueryError
from ..plans.values import canonical
from .times import HOUR, Range, auto_step, expand_macros, parse_duration_value

TYPES = ("timeseries", "stat", "table")
HEIGHT = 240
LEAST_REFRESH_S = 5
# Unit names, and pixels of an axis.
BYTES, SECONDS = {"b", "byte", "bytes"}, {"s", "sec", "secs", "second", "seconds"}
AXIS_LEAST, AXIS_MOST, AXIS_CHARACTER, AXIS_PADDING = 70, 140, 7, 20


@dataclass(frozen=True)
class PanelQuery:
    expr: str
    legend: str | None = None


@dataclass(frozen=True)
class Panel:
    queries: tuple[PanelQuery, ...]
    type: str = "timeseries"
    title: str | None = None
    range_ms: float = HOUR
    step_ms: float | None = None
    refresh_s: float | None = None
    unit: str | None = None
    min: float | None = None
    max: float | None = None
    height: float = HEIGHT

    def step(self) -> float:
        return self.step_ms if self.step_ms is not None else auto_step(self.range_ms)

    def run(self, engine: Engine, r: Range) -> list[DataFrame]:
        """A table for each query: (metric, step, value), over the range or, for stat and table, at its end."""
        out = []
        for q in self.queries:
            text = expand_macros(q.expr, r)
            start = r.start_ms if self.type == "timeseries" else r.end_ms
            out.append(engine.table(text, int(start), int(r.end_ms), int(r.step_ms)))
        return out


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def _number(value: object) -> float | None:
    return value if isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value) else None


def _duration(value: object, key: str) -> float:
    ms = parse_duration_value(value)
    if ms is None:
        raise QueryError(f"{key}: expected a duration like 5m or a number of seconds")
    return ms


def panel(raw: object) -> Panel:
    """From a query, or a mapping with ``query``, ``expr`` or ``queries`` and options."""
    raw = {"query": raw} if isinstance(raw, str) else raw
    if not isinstance(raw, dict):
        raise QueryError("panel config must be a PromQL query or a YAML mapping")
    found = []
    single = raw.get("query", raw.get("expr"))
    if isinstance(single, str) and single.strip():
        found.append(PanelQuery(single.strip(), _text(raw.get("legend"))))
    for entry in raw["queries"] if isinstance(raw.get("queries"), list) else []:
        if isinstance(entry, str):
            found.append(PanelQuery(entry.strip()))
        elif isinstance(entry, dict) and isinstance(entry.get("expr"), str):
            found.append(PanelQuery(entry["expr"].strip(), _text(entry.get("legend"))))
    if not found:
        raise QueryError('panel needs a query — either a bare PromQL expression or a "query:" key')
    kind = raw.get("type") or "timeseries"
    if kind not in TYPES:
        raise QueryError(f'unknown panel type "{kind}" (use timeseries, stat, or table)')
    refresh = raw.get("refresh")
    return Panel(
        tuple(found),
        kind,
        _text(raw.get("title")),
        _duration(raw["range"], "range") if "range" in raw else HOUR,
        _duration(raw["step"], "step") if "step" in raw else None,
        None if refresh is None or refresh is False else max(LEAST_REFRESH_S, _duration(refresh, "refresh") / 1000),
        _text(raw.get("unit")),
        _number(raw.get("min")),
        _number(raw.get("max")),
        _number(raw.get("height")) or HEIGHT,
    )


def parse_panel(source: str, load) -> Panel:
    """From a block's text; ``load`` parses YAML, and what isn't a mapping is a query."""
    text = source.strip()
    if not text:
        raise QueryError("empty promql block")
    try:
        raw = load(text)
    except Exception:  # noqa: BLE001  a query need not be YAML
        raw = text
    return panel(raw if isinstance(raw, dict | list) else text)


def align(rows: DataFrame, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
    """A row for each label set of (labels, step, value): its values on the whole grid, null where there is none; the last counts in a slot."""
    n = (end_ms - start_ms) // step_ms + 1
    slot = F.floor((F.col("step") - start_ms) / F.lit(float(step_ms)) + 0.5).cast("int")
    fits = rows.select("labels", "step", slot.alias("slot"), "value").where((F.col("slot") >= 0) & (F.col("slot") < n))
    once = fits.groupBy(canonical(F.col("labels")).alias("key"), "slot").agg(F.first("labels").alias("labels"), F.max_by("value", "step").alias("value"))
    each = once.groupBy("key").agg(F.first("labels").alias("labels"), F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
    return each.select("labels", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at("m", i)).alias("values"))


def _pairs(metric: dict[str, str], hidden: set[str]) -> str:
    return ", ".join(f'{k}="{metric[k]}"' for k in sorted(metric) if k != NAME and k not in hidden)


def legend(metric: dict[str, str], template: str | None = None) -> str:
    if template:
        return re.sub(r"\{\{\s*([^}\s]+)\s*\}\}", lambda m: metric.get(m[1], ""), template)
    name, pairs = metric.get(NAME, ""), _pairs(metric, set())
    return f"{name}{{{pairs}}}" if pairs else name or "value"


def legends(series: list[tuple[dict[str, str], str | None]]) -> list[str]:
    """Of all series of a panel. Labels, and the name, that all without a template have in common are left out."""
    plain = [m for m, template in series if not template]
    common = {k for k, v in plain[0].items() if k != NAME and all(m.get(k) == v for m in plain)} if plain else set()
    same_name = len(plain) > 1 and len({m.get(NAME, "") for m in plain}) == 1
    out = []
    for metric, template in series:
        if template:
            out.append(legend(metric, template))
            continue
        name, pairs = "" if same_name else metric.get(NAME, ""), _pairs(metric, common)
        out.append(f"{name}{{{pairs}}}" if name and pairs else pairs or name or "value")
    return out


def axis_size(labels: list[object]) -> int:
    longest = max((len(str(x)) for x in labels), default=0)
    return max(AXIS_LEAST, min(AXIS_MOST, longest * AXIS_CHARACTER + AXIS_PADDING))


def format_stat(v: float) -> str:
    if not math.isfinite(v):
        return "NaN" if math.isnan(v) else "∞" if v > 0 else "-∞"
    for least, size, suffix in ((1e9, 1e9, "B"), (1e6, 1e6, "M"), (1e4, 1e3, "k")):
        if abs(v) >= least:
            return f"{v / size:.2f}{suffix}"
    if v == int(v):
        return number_text(v)
    if abs(v) >= 1:
        return f"{v:.2f}"
    digits = 2 - math.floor(math.log10(abs(float(f"{v:.2e}"))))
    return f"{v:.{digits}f}" if digits <= 8 else re.sub(r"e([+-])0*", r"e\1", f"{v:.2e}")


def format_unit(v: float, unit: str | None = None) -> str:
    kind = (unit or "").lower()
    if not math.isfinite(v):
        return format_stat(v)
    if kind in BYTES:
        for power, digits, name in ((3, 2, "GiB"), (2, 1, "MiB"), (1, 1, "KiB")):
            if abs(v) >= 1024**power:
                return f"{v / 1024**power:.{digits}f} {name}"
        return f"{v:.0f} B"
    if kind in SECONDS:
        if 0 < abs(v) < 1:
            return f"{v * 1000:.{2 if abs(v) < 0.01 else 0}f} ms"
        return f"{format_stat(v)} s"
    return format_stat(v) + (f" {unit}" if unit else "")
