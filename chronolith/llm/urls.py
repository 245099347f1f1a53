"""URL filters: rules by host and path, and a character language-model ratio for what no rule fits.

URLs that a rule fits are the training data: accepted and rejected ones each
give a smoothed variable-order Markov model. Characters are folded into 38
symbols; the probability of a symbol after its context is interpolated with
those after the context's ever shorter ends (Witten-Bell: a context weighs as
much as it has been seen and as little as it has had different followers), down
to a uniform one. Contexts of up to two symbols are all used; one of three or
four is if it precedes at least 1 in ``SHARE`` of all symbols learnt from, so
there are at most ``SHARE`` of each length, whatever the input. A URL's score is
the mean over its symbols of the log ratio of the two models; the threshold is
the one of least balanced error on a fifth of the rule-judged URLs, by crc32 of
the URL, which the models don't learn from.

All of it is DataFrame functions. What precedes a used context, and what ends
it, is used too, so the longest used context after a symbol follows from the one
before it: the models are one automaton, whose states are the contexts, with a
next state and a log ratio for each symbol. Its tables (at most 219,063 numbers
each) reach the rows as scalar subqueries; the URLs themselves are never
shuffled or joined, so a hot host costs nothing, and a URL takes time linear in its length.

Rows: null urls and such without ``://`` have an empty host and path and no
rule; null and empty urls score 0. Repeated rows are judged alike. Without
rule-judged URLs of both verdicts all scores and the threshold are 0, so what
no rule fits is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, durable

#: (verdict, host and path). The longest rule that fits wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols that are not letters, and the capitals that stand for them; L is any other, M stands before the start.
MARKS, CAPITALS = "0123456789./-_?=&%:#", "AAAAAAAAAABCDEFGHIJK"
SYMBOLS = 39
PAD = 12
#: Longest context; those of over two symbols are used from this share of all symbols.
DEPTH, SHARE = 4, 2048
#: Held-out scores are counted in bins of 1 / BINS between -LIMIT / BINS and LIMIT / BINS.
BINS, LIMIT = 50, 400
FOLDS = 5


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for what, name in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = name.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """Array of symbol numbers: 0 to 12 for the capitals A to M, 13 to 38 for letters."""
    folded = F.translate(url, UPPER, LOWER)
    folded = F.regexp_replace(folded, r"[^a-z0-9./\-_?=&%:#]", "~")
    folded = F.translate(folded, MARKS + "~", CAPITALS + "L")
    letters = F.filter(F.split(F.coalesce(folded, F.lit("")), ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.when(c >= "a", F.ascii(c) - F.lit(84)).otherwise(F.ascii(c) - F.lit(65)))


def _shifted(values: Column, by: int, fill: int) -> Column:
    """Each place has what was ``by`` places before it."""
    return F.slice(F.concat(F.array_repeat(F.lit(fill), by), values), 1, F.size(values))


def _grams(judged: DataFrame) -> DataFrame:
    """(code, a, b): how often each five symbols in a row end in accepted and in rejected URLs, from rows (verdict, codes)."""
    pairs = judged.withColumn("pairs", F.zip_with(_shifted(F.col("codes"), 1, PAD), "codes", lambda p, c: p * SYMBOLS + c))
    fours = pairs.withColumn("fours", F.zip_with(_shifted(F.col("pairs"), 2, PAD * SYMBOLS + PAD), "pairs", lambda p, c: p * SYMBOLS**2 + c))
    fives = fours.select("verdict", F.explode(F.zip_with(_shifted(F.col("codes"), DEPTH, PAD), "fours", lambda p, c: p * SYMBOLS**DEPTH + c)).alias("code"))
    return fives.groupBy("code").agg(F.sum(F.when(F.col("verdict") == "allow", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("b"))


def _followers(grams: DataFrame, order: int) -> DataFrame:
    """(x, c, seen_a, seen_b): how often symbol c came after context x of ``order`` symbols."""
    tail = F.col("code") % SYMBOLS ** (order + 1)
    rows = grams.select(F.floor(tail / SYMBOLS).cast("int").alias(f"x{order}"), (F.col("code") % SYMBOLS).cast("int").alias("c"), "a", "b")
    return rows.groupBy(f"x{order}", "c").agg(F.sum("a").alias(f"seen{order}a"), F.sum("b").alias(f"seen{order}b"))


def _contexts(followers: DataFrame, order: int) -> DataFrame:
    """Times a context was seen, and its different followers."""
    return followers.groupBy(f"x{order}").agg(*[x for s in "ab" for x in (F.sum(f"seen{order}{s}").alias(f"n{order}{s}"), F.sum((F.col(f"seen{order}{s}") > 0).cast("int")).alias(f"t{order}{s}"))])


def model(judged: DataFrame) -> DataFrame:
    """One row: the automaton's first state, next states and log ratios (by state and symbol), from judged rows (verdict, codes)."""
    spark = judged.sparkSession
    grams = durable(_grams(judged))
    short = durable(_followers(grams, 3).select((F.col("x3") * SYMBOLS + F.col("c")).alias("code"), F.col("seen3a").alias("a"), F.col("seen3b").alias("b")))
    followers = {order: _followers(grams if order == DEPTH else short, order) for order in range(DEPTH + 1)}
    contexts = {order: _contexts(followers[order], order) for order in followers}
    totals = contexts[0].drop("x0")
    all_ = totals.select(F.col("n0a") + F.col("n0b"))
    used = [contexts[k].where((F.col(f"n{k}a") + F.col(f"n{k}b")) * SHARE >= all_.scalar()).select(F.lit(k).alias("order"), F.col(f"x{k}").alias("x")) for k in (3, DEPTH)]
    # Two times SHARE rows at most, so one task numbers them.
    longer = durable(used[0].unionByName(used[1]).withColumn("state", F.row_number().over(Window.orderBy("order", "x")) + F.lit(SYMBOLS**2 - 1)))
    states = spark.range(SYMBOLS**2).select(F.lit(2).alias("order"), F.col("id").cast("int").alias("x"), F.col("id").cast("int").alias("state")).unionByName(longer)

    rows = states.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(SYMBOLS - 1))))
    after = F.col("x") * SYMBOLS + F.col("c")
    rows = rows.withColumns({f"x{k}": F.when(F.col("order") >= k, F.col("x") % SYMBOLS**k) for k in range(DEPTH + 1)})
    rows = rows.withColumns({"y2": after % SYMBOLS**2, "y3": after % SYMBOLS**3, "y4": F.when(F.col("order") > 2, after % SYMBOLS**DEPTH)})
    for k in (3, DEPTH):
        rows = rows.join(longer.where(F.col("order") == k).select(F.col("x").alias(f"y{k}"), F.col("state").alias(f"to{k}")), f"y{k}", "left")
    for k in range(DEPTH + 1):
        if k > 2:  # only what is used, before the join
            own = longer.where(F.col("order") == k).select(F.col("x").alias(f"x{k}"))
            followers[k], contexts[k] = followers[k].join(own, f"x{k}", "left_semi"), contexts[k].join(own, f"x{k}", "left_semi")
        rows = rows.join(followers[k], [f"x{k}", "c"], "left").join(contexts[k], f"x{k}", "left")

    def probability(s: str) -> Column:
        p = F.lit(1.0 / SYMBOLS)
        for k in range(DEPTH + 1):
            n, t, seen = F.col(f"n{k}{s}"), F.col(f"t{k}{s}"), F.coalesce(f"seen{k}{s}", F.lit(0))
            p = F.when(n > 0, (seen + t * p) / (n + t)).otherwise(p)
        return p

    both = (F.col("n0a") > 0) & (F.col("n0b") > 0)
    ratio = F.when(both, F.ln(probability("a")) - F.ln(probability("b"))).otherwise(0.0)
    cells = rows.select((F.col("state") * SYMBOLS + F.col("c")).alias("cell"), F.coalesce("to4", "to3", "y2").cast("int").alias("next"), ratio.alias("ratio"))
    cells = cells.agg(F.array_sort(F.collect_list(F.struct("cell", "next", "ratio"))).alias("cells"))
    start = [sum(PAD * SYMBOLS**i for i in range(k)) for k in range(DEPTH + 1)]
    first = longer.where(F.col("x") == F.when(F.col("order") == 3, start[3]).otherwise(start[4])).agg(F.coalesce(F.max("state"), F.lit(start[2])).cast("int"))
    return cells.select(first.scalar().alias("first"), F.transform("cells", lambda x: x["next"]).alias("next"), F.transform("cells", lambda x: x["ratio"]).alias("ratios"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the score of least balanced error; ties to the one nearest to 0, then the smaller; 0 if a verdict is missing."""
    spark = scored.sparkSession
    bin_ = F.least(F.greatest(F.floor(F.col("score") * BINS), F.lit(-LIMIT)), F.lit(LIMIT)).alias("bin")
    counts = scored.groupBy(bin_).agg(F.sum((F.col("verdict") == "allow").cast("int")).alias("a"), F.sum((F.col("verdict") == "block").cast("int")).alias("b"))
    bins = spark.range(-LIMIT, LIMIT + 1).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    rows = F.array_sort(F.collect_list(F.struct("bin", "a", "b")))  # 801 bins at any input size
    one = bins.agg(rows.alias("bins"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    errors = F.transform("bins", lambda x: F.struct(_missed(x).alias("error"), F.abs(x["bin"]).alias("far"), x["bin"].alias("bin")))
    best = F.array_min(errors)["bin"] / F.lit(float(BINS))
    return one.select(F.when((F.col("a") > 0) & (F.col("b") > 0), best).otherwise(0.0).alias("threshold"))


def _missed(at: Column) -> Column:
    """Shares of accepted URLs below a bin and of rejected ones from it on, together."""
    sums = F.aggregate(
        "bins",
        F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")),
        lambda s, y: F.struct((s["a"] + F.when(y["bin"] < at["bin"], y["a"]).otherwise(0)).alias("a"), (s["b"] + F.when(y["bin"] >= at["bin"], y["b"]).otherwise(0)).alias("b")),
    )
    return sums["a"] / F.greatest(F.col("a"), F.lit(1)) + sums["b"] / F.greatest(F.col("b"), F.lit(1))


def judge(pages: DataFrame, rules=RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, host, path, rule, verdict and score for each row."""
    names = carried(pages, keep, ["host", "path", "rule", "verdict", "score", "__url"])
    rows = pages.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{url}`").cast("string").alias("__url"))
    host, path = parts(F.col("__url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict, "codes": symbols(F.col("__url"))})
    judged = rows.where("by_rule is not null").select(F.col("by_rule").alias("verdict"), "codes", (F.crc32("__url") % FOLDS == 0).alias("held"))
    learnt = durable(model(judged.where(~F.col("held"))))  # one row, at most 2.6 MB

    def scored(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({f"__{c}": learnt.select(c).scalar() for c in ("first", "next", "ratios")})

        def step(s: Column, c: Column) -> Column:
            cell = s["state"] * SYMBOLS + c
            return F.struct(F.get(F.col("__next"), cell).alias("state"), (s["total"] + F.get(F.col("__ratios"), cell)).alias("total"))

        total = F.aggregate("codes", F.struct(F.col("__first").alias("state"), F.lit(0.0).alias("total")), step, lambda s: s["total"])
        return rows.withColumn("score", F.when(F.size("codes") > 0, total / F.size("codes")).otherwise(0.0))

    cut = durable(threshold(scored(judged.where("held")).select("verdict", "score")))
    rows = scored(rows)
    by_score = F.when(F.col("score") >= cut.scalar(), F.lit("allow")).otherwise(F.lit("block"))
    return rows.select(*[F.col(f"`{c}`") for c in names], "host", "path", "rule", F.coalesce("by_rule", by_score).alias("verdict"), "score")

