"""The corpus pipeline against its stages done by hand, and the registered queries."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from chronolith.llm import bpe, language
from test_operators import brute_components, brute_contaminated, brute_fingerprint, brute_language, brute_secrets

SMALL = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    seen = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = language.train(spark.read.parquet(f"{SMALL}/documents.parquet").where(seen))
    found = {i: brute_language(r.text, model) for i, r in docs.items()}
    n = len(model.languages)
    ids = [i for i, (label, score) in found.items() if label != "und" and score >= 1 / n + language.ABOVE_CHANCE * (1 - 1 / n)]
    comps = brute_components(ids, [brute_fingerprint(docs[i].text) for i in ids])
    kept = [i for i in sorted(set(comps)) if not brute_contaminated(docs[i].text, items)[4]]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i in kept:
        text, to, parts = docs[i].text, 0, []
        for a, _, b in brute_secrets(text):
            if a >= to or not parts:
                parts += [text[to:a], "[SECRET]"]
            to = max(to, b)
        text = "".join([*parts, text[to:]])
        tokens = encoding.encode_ordinary(text)
        want[i] = (found[i][0], len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.lang, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want and len(got) < len(docs)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns, name


EN, DE = "the small house stands near the river and the old mill", "das kleine haus steht nahe am fluss und der alten muehle"
SECRET = "password=abcdefghij"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, Spans string, score int, component_id string, starts int, `__id` string, `a.b` int"


def odd_rows():
    """Texts for ids of 0 and up, a repeated row, rows without an id, nulls in each column; the extra columns clash with the operators' own."""
    more = ["x", 1, "y", 2, "z", 3]
    texts = [f"{EN} number {i}" for i in range(12)] + [f"{DE} nummer {i}" for i in range(12)] + [None, "", "1234 !!", EN + " far away and long ago " * 50_000, f"{EN} {SECRET}"]
    rows = [(i, t, None if not t else "de" if t.startswith("das") else "en", None, len(t or ""), *more) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, DE + " ohne nummer", None, None, None, *[None] * 6), (None, None, None, None, None, *[None] * 6)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with a passage that contaminates the German texts with and without an id."""
    place = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, DE), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_language_stage_of_odd_rows(spark, odd, folder):
    got = corpus_pipeline.language_id(spark, odd, folder)
    assert got.columns == odd.columns
    lang = lambda r: "de" if r[1].startswith("das") else "en"
    assert rows_of(got) == Counter((*r[:2], lang(r), *r[3:]) for r in odd_rows() if r[1] and r[1] != "1234 !!")
    assert corpus_pipeline.language_id(spark, odd.withColumn("lang", F.lit(None).cast("string")), folder).count() == 0


def test_near_dedup_stage_of_odd_rows(spark, odd, folder):
    rows = odd_rows()
    got = rows_of(corpus_pipeline.near_dedup(spark, odd, folder))
    comps = brute_components([r[0] if r[0] is not None else 1_000 + i for i, r in enumerate(rows)], [brute_fingerprint(r[1]) for r in rows])
    want = Counter()
    for comp in set(comps):
        own = [r for r, c in zip(rows, comps, strict=True) if c == comp]
        want[min(own, key=lambda r: (r[0] is None, r[0]))] += 1
    assert got == want


def test_decontamination_stage_of_odd_rows(spark, odd, folder):
    got = corpus_pipeline.decontamination(spark, odd, folder)
    assert rows_of(got) == Counter(r for r in odd_rows() if not (r[1] or "").startswith("das"))


def test_secrets_stage_of_odd_rows(spark, odd, folder):
    want = Counter()
    for r in odd_rows():
        text = r[1] and r[1].replace(SECRET, "[SECRET]")
        want[(r[0], text, *r[2:4], None if text is None else len(text), *r[5:])] += 1
    assert rows_of(corpus_pipeline.mask_secrets(spark, odd, folder)) == want


def test_last_stage_of_odd_rows(spark, odd, folder):
    got = corpus_pipeline.encode(spark, odd, folder)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r.doc_id, r.lang, r.source, r.decoded_sha256) for r in got.collect()) == Counter((r[0], r[2], r[3], digest(r[1])) for r in odd_rows())
    assert {r.n_tokens for r in got.where("doc_id in (24, 25)").collect()} == {0}


def test_whole_pipeline_of_odd_and_empty_tables(spark, odd, folder):
    """Copies of one language are dropped, then the German texts; what's left is masked and encoded."""
    odd.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and {r.lang for r in got} == {"en"} and len({r.doc_id for r in got}) == len(got)
    odd.limit(0).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), folder).count() == 0, name


def test_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
