"""Secret scans: one combined automaton for all rules.

Kinds and their order are those of ``RULES``; the first three are the base
kinds. Texts may hold any character: byte 0 inside a text is read as a byte
that no rule can match. Null and empty texts have no spans; repeated rows have
repeated spans; touching or overlapping spans of different kinds are all given.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .automaton import Rule, Scanner
from .common import map_texts, text_bytes


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_HEAD = f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?"
BASE = ("assign", "access", "hex")
RULES = [
    Rule("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", 8, _HEAD),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32,}", 32),  # a maximal run, as [0-9a-f]+ with shorter runs dropped
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: list[Rule]) -> Scanner:
    """Compiled once a process; the compiled form depends on the rules alone."""
    key = tuple(rules)
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(rules)
    return _SCANNERS[key]


def _texts(column: pa.Array) -> list[bytes]:
    raw, at = text_bytes(column)
    whole = raw.tobytes().replace(b"\0", b"\x01")
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points."""
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the spans (kind, start, end in code points) in order."""

    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            texts = _texts(column)
            rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in _points(t, s)] if s else [] for t, s in zip(texts, scanner(rules).matches(texts), strict=True)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return [pa.array(rows, kind)]

        return run

    return map_texts(docs, text, keep, [T.StructField("spans", SPAN)], make)


def digest(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, a count for each base kind, base_sha256, and all spans as a string."""
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            texts = _texts(column)
            counts, digests, joined = [[] for _ in BASE], [], []
            for t, spans in zip(texts, scanner(RULES).matches(texts), strict=True):
                spans = _points(t, spans) if spans else spans
                for k, out in enumerate(counts):
                    out.append(sum(s[1] == k for s in spans))
                name = lambda s: f"{RULES[s[1]].kind}:{s[0]}:{s[2]}"
                digests.append(hashlib.sha256(",".join(name(s) for s in spans if s[1] < len(BASE)).encode()).hexdigest())
                joined.append(",".join(map(name, spans)))
            return [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(joined, pa.string())]

        return run

    return map_texts(docs, text, keep, fields, make)


def redact(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``keep`` and the text with each run of overlapping spans replaced by ``mark``; null stays null."""

    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            texts, originals = _texts(column), column.to_pylist()
            new = []
            for original, spans in zip(originals, scanner(rules).matches(texts), strict=True):
                if not spans:
                    new.append(original)
                    continue
                raw, parts, to = original.encode(), [], 0
                for a, _, b in spans:
                    if a >= to or not parts:
                        parts += [raw[to:a], mark.encode()]
                    to = max(to, b)
                new.append(b"".join([*parts, raw[to:]]).decode())
            return [pa.array(new, pa.string())]

        return run

    return map_texts(docs, text, keep, [T.StructField(out, T.StringType())], make)
