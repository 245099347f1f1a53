"""Checking SQL (DuckDB) of those operators that SQL can express; plain and slow."""

from __future__ import annotations

from .decontaminate import WINDOW
from .secrets import BASE, RULES as SECRETS
from .simhash import DISTANCE, SEED, SHINGLE
from .suffix import LENGTH
from .topk import SCALE
from .urls import BINS, DEPTH, FOLDS, LIMIT, LOWER, PAD, RULES, SHARE, SYMBOLS, UPPER

_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
items AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS win
  FROM b, unnest(range(1, greatest(2, len(w) - {WINDOW} + 2))) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM items),
wins AS (SELECT rid, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes)),
hits AS (SELECT rid, i, k, item FROM wins JOIN items USING (k, win)),
spots AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT DISTINCT rid, i, k FROM hits), unnest(range(i, i + k)) AS r(p) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(spots.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(spots.n, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (rid) LEFT JOIN found USING (rid)"""

TOP_K = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

SUFFIX = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, i, md5(substring(h, 2 * i + 1, {2 * LENGTH})) AS k FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d)),
rep AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM w SEMI JOIN rep USING (k)),
r AS (SELECT rid, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY i) AS g FROM s) GROUP BY rid, g),
e AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM r),
k AS (SELECT rid, sum(b - a) AS removed, count(*) AS n, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substring(h, 2 * last + 1)) AS kept
  FROM (SELECT e.*, h, max(b) OVER (PARTITION BY e.rid) AS last FROM e JOIN d USING (rid)) GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(from_hex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""


def _rules(verdict: bool) -> str:
    """The longest rule that fits, or its verdict."""
    tests = []
    for what, name in sorted(RULES, key=lambda r: -len(r[1])):
        domain, slash, rest = name.partition("/")
        tests.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash + rest}') THEN '{what if verdict else name}'")
    return f"CASE {' '.join(tests)} END"


def _orders() -> str:
    """Followers f0 to f4 and used contexts x0 to x4."""
    parts = []
    for k in range(DEPTH + 1):
        parts.append(f"f{k} AS (SELECT x % {SYMBOLS**k} AS x, c, count(*) FILTER (WHERE by_rule = 'allow') AS a, count(*) FILTER (WHERE by_rule = 'block') AS b FROM t WHERE by_rule IS NOT NULL AND NOT held GROUP BY ALL)")
        enough = f" HAVING sum(a + b) * {SHARE} >= (SELECT sum(a + b) FROM f0)" if k > 2 else ""
        parts.append(f"x{k} AS (SELECT x, sum(a) AS na, count(*) FILTER (WHERE a > 0) AS ta, sum(b) AS nb, count(*) FILTER (WHERE b > 0) AS tb FROM f{k} GROUP BY x{enough})")
    return ",\n".join(parts)


def _probability(s: str) -> str:
    p = f"(1.0::DOUBLE / {SYMBOLS})"
    for k in range(DEPTH + 1):
        p = f"(CASE WHEN coalesce(x{k}.n{s}, 0) > 0 THEN (coalesce(f{k}.{s}, 0) + x{k}.t{s} * {p}) / (x{k}.n{s} + x{k}.t{s}) ELSE {p} END)"
    return p


_JOINS = " ".join(f"LEFT JOIN f{k} ON f{k}.x = t.x % {SYMBOLS**k} AND f{k}.c = t.c LEFT JOIN x{k} ON x{k}.x = t.x % {SYMBOLS**k}" for k in range(DEPTH + 1))
_CONTEXT = " + ".join(f"codes[i + {k}]::BIGINT * {SYMBOLS ** (DEPTH - 1 - k)}" for k in range(DEPTH))
_SYMBOLS = f"0./-_?=&%:#~^{LOWER}"
_BYTES = "list_transform(range(length(hex(encode(coalesce(url, '')))) // 2), lambda i: CAST('0x' || substring(hex(encode(coalesce(url, ''))), 2 * i + 1, 2) AS BIGINT))"
_BIT = "xor(c >> 1, 3988292384 * (c & 1))"
_CRC = f"xor(list_reduce({_BYTES}, lambda c0, x: list_reduce(range(8), lambda c, k: {_BIT}, xor(c0, x)), 4294967295::BIGINT), 4294967295::BIGINT)"

URLS = f"""WITH p0 AS (SELECT row_number() OVER () AS rid, page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p1 AS (SELECT rid, page_id, url, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p0),
p2 AS (SELECT *, {_rules(False)} AS rule, {_rules(True)} AS by_rule, {_CRC} % {FOLDS} = 0 AS held,
  translate(regexp_replace(translate(coalesce(url, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9./\\-_?=&%:#]', '~', 'g'), '123456789', '000000000') AS s FROM p1),
t AS (SELECT rid, by_rule, held, i, {_CONTEXT} AS x, codes[i + {DEPTH}] AS c
  FROM (SELECT *, list_concat({[PAD] * DEPTH}, list_transform(range(1, length(s) + 1), lambda j: strpos('{_SYMBOLS}', substring(s, j, 1)) - 1)) AS codes, unnest(range(1, length(s) + 1)) AS i FROM p2)),
{_orders()},
ratios AS (SELECT t.x, t.c, CASE WHEN x0.na > 0 AND x0.nb > 0 THEN ln({_probability("a")}) - ln({_probability("b")}) ELSE 0 END AS ratio
  FROM (SELECT DISTINCT x, c FROM t) AS t {_JOINS}),
scored AS (SELECT rid, sum(ratio) / count(*) AS score FROM t JOIN ratios USING (x, c) GROUP BY rid),
rows_ AS (SELECT p2.*, coalesce(score, 0.0::DOUBLE) AS score FROM p2 LEFT JOIN scored USING (rid)),
h AS (SELECT by_rule, greatest({-LIMIT}, least({LIMIT}, floor(score * {BINS}))) AS bin FROM rows_ WHERE by_rule IS NOT NULL AND held),
cuts AS (SELECT t, count(*) FILTER (WHERE by_rule = 'allow' AND bin < t) / count(*) FILTER (WHERE by_rule = 'allow') + count(*) FILTER (WHERE by_rule = 'block' AND bin >= t) / count(*) FILTER (WHERE by_rule = 'block') AS error
  FROM h, (SELECT unnest(range({-LIMIT}, {LIMIT + 1})) AS t) GROUP BY t),
cut AS (SELECT coalesce((SELECT t / {BINS}.0::DOUBLE FROM cuts WHERE error IS NOT NULL AND NOT isnan(error) ORDER BY error, abs(t), t LIMIT 1), 0.0) AS threshold)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score FROM rows_, cut"""



def _spans(order: int) -> str:
    """Matches of one kind: what lies before and between them gives their places; (rid, kind, start, end in code points)."""
    rule = SECRETS[order]
    pattern = rule.pattern.replace("'", "''").replace("(", "(?:")
    long = f"length(m) >= {rule.least}"
    if rule.head:  # the length of what follows the head
        long = f"length(m) - length(regexp_extract(m, '^{rule.head.replace(chr(39), chr(39) * 2)}')) >= {rule.least}"
    return f"""SELECT rid, {order} AS k, '{rule.kind}' AS kind, a, a + length(m) AS b FROM (
  SELECT rid, ms[i] AS m, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, regexp_extract_all(s, '{pattern}') AS ms, regexp_split_to_array(s, '{pattern}') AS gaps FROM d))) WHERE {long}"""


SECRET_SPANS = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS s FROM documents),
p AS ({" UNION ALL ".join(_spans(k) for k in range(len(SECRETS)))}),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{kind}" for k, kind in enumerate(BASE))},
  string_agg(format('{{}}:{{}}:{{}}', kind, a, b), ',' ORDER BY a, k) FILTER (WHERE k < {len(BASE)}) AS base, string_agg(format('{{}}:{{}}:{{}}', kind, a, b), ',' ORDER BY a, k) AS spans FROM p GROUP BY rid)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}" for kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


#: The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_WRAP = "18446744073709551616::UHUGEINT"


def _rotated(x: str, by: int) -> str:
    """To the left: times a power of two, where 2^64 counts as 1."""
    return f"((({x}) * {1 << by}::UHUGEINT) % 18446744073709551615::UHUGEINT)"


def _times(x: str, prime: int, plus: str = "0") -> str:
    return f"((({x}) * {prime}::UHUGEINT + {plus}::UHUGEINT) % {_WRAP})"


def _round(lane: str, before: str = "0") -> str:
    return _times(_rotated(_times(lane, _P2, f"({before})"), 31), _P1)


def _lane(at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes from a place of x, a text in hex."""
    return "CAST('0x' || " + " || ".join(f"substring(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + " AS UBIGINT)::UHUGEINT"


def _accumulator(k: int) -> str:
    start = (SEED + (_P1 + _P2, _P2, 0, -_P1)[k]) % (1 << 64)
    lanes = f"list_transform(range(n // 32), lambda i: {_lane(f'32 * i + {8 * k}', 8)})"
    return f"list_reduce({lanes}, lambda v, lane: {_round('lane', 'v')}, {start}::UHUGEINT) AS v{k}"


def _xxh64() -> str:
    """Stages from sh (shingle) to h0 (shingle, h)."""
    mixed = f"(({_rotated('v0', 1)} + {_rotated('v1', 7)} + {_rotated('v2', 12)} + {_rotated('v3', 18)}) % {_WRAP})"
    for k in range(4):
        mixed = _times(f"xor({mixed}, {_round(f'v{k}')})", _P1, str(_P4))
    eights = f"list_transform(range(n // 32 * 32, n // 8 * 8, 8), lambda i: {_lane('i', 8)})"
    ones = f"list_transform(range(n // 4 * 4, n), lambda i: {_lane('i', 1)})"
    h1 = f"list_reduce({eights}, lambda h, lane: {_times(_rotated(f'xor(h, {_round("lane")})', 27), _P1, str(_P4))}, h)"
    h2 = f"CASE WHEN n % 8 >= 4 THEN {_times(_rotated(f'xor(h, {_times(_lane("n // 8 * 8", 4), _P1)})', 23), _P2, str(_P3))} ELSE h END"
    h3 = f"list_reduce({ones}, lambda h, lane: {_times(_rotated(f'xor(h, {_times("lane", _P5)})', 11), _P1)}, h)"
    steps = [h1, h2, h3, _times(f"xor(h, h // {1 << 33}::UHUGEINT)", _P2), _times(f"xor(h, h // {1 << 29}::UHUGEINT)", _P3), f"xor(h, h // {1 << 32}::UHUGEINT)"]
    out = f"SELECT shingle, x, n, (CASE WHEN n >= 32 THEN {mixed} ELSE {SEED + _P5}::UHUGEINT END + n::UHUGEINT) % {_WRAP} AS h FROM (SELECT *, {', '.join(map(_accumulator, range(4)))} FROM (SELECT shingle, hex(encode(shingle)) AS x, strlen(shingle) AS n FROM (SELECT DISTINCT shingle FROM sh)))"
    for step in steps:
        out = f"SELECT shingle, x, n, {step} AS h FROM ({out})"
    return out


_BITS = " + ".join(f"CASE WHEN 2 * count(*) FILTER (WHERE (h // {1 << j}::UBIGINT) % 2 = 1) > count(*) THEN {1 << j}::UHUGEINT ELSE 0::UHUGEINT END" for j in range(64))
SIMHASH = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT rid, array_to_string(list_slice(w, i, i + least(len(w), {SHINGLE}) - 1), ' ') AS shingle FROM d, unnest(range(1, greatest(2, len(w) - {SHINGLE} + 2))) AS r(i) WHERE len(w) > 0),
h0 AS MATERIALIZED (SELECT shingle, CAST(h AS UBIGINT) AS h FROM ({_xxh64()})),
f AS MATERIALIZED (SELECT d.rid, doc_id, coalesce(fp, 0) AS fp FROM d LEFT JOIN (SELECT rid, CAST({_BITS} AS UBIGINT) AS fp FROM sh JOIN h0 USING (shingle) GROUP BY rid) AS b USING (rid)),
u AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
e AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM u AS a JOIN u AS b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {DISTANCE}),
reach AS (SELECT fp AS a, fp AS b FROM u UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT reach.a AS fp, min(u.least) AS component_id FROM reach JOIN u ON reach.b = u.fp GROUP BY reach.a)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM f JOIN c USING (fp)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": DECONTAMINATE, "op2_top_k": TOP_K, "op3_secrets": SECRET_SPANS, "op4_simhash": SIMHASH, "op5_url_filter": URLS, "op10_suffix_dedup": SUFFIX}
