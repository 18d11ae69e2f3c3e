"""Quality rules as a learned decision list. DataFrame operations only.

Statistics of each text are native expressions. Sequential covering learns from labelled statistics:
a rule grows by the threshold test of best information gain on two thirds of the rows, is pruned on the
rest, and its rows are set aside before the next rule grows. Only counts per feature and bin reach the
driver. The list is emitted as one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words, written

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: Thresholds a feature; tests a rule; rules a list; least precision and rows of a rule on the pruning rows.
BINS, MAX_TESTS, MAX_RULES, MIN_PRECISION, MIN_ROWS = 24, 3, 6, 0.8, 5
FEATURES = ("n_words", "word_len", "symbol_rate", "dup_rate", "repeat_rate", "upper_rate", "digit_rate", "line_len")


@dataclass(frozen=True)
class Test:
    """feature > value, or feature <= value."""

    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; precision and rows as seen on the pruning rows."""

    tests: tuple[Test, ...]
    precision: float
    rows: int

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column()
        return out


def repeat_words(w: Column, n: int = REPEAT_WINDOW) -> Column:
    """Words of an array in n-word windows that occur twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash of their words. The hashes are sorted once; only texts with
    equal neighbours go on to sort (hash, position) and join the covered positions up.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def marked(s: Column) -> Column:
            twin = F.filter(s, lambda v, j: (F.get(s, j - 1)["x"].eqNullSafe(v["x"])) | (F.get(s, j + 1)["x"].eqNullSafe(v["x"])))
            return F.sort_array(F.transform(twin, lambda v: v["i"]))

        def add(acc: Column, p: Column) -> Column:
            return F.struct((p + n).alias("end"), (acc["n"] + p + n - F.greatest(p, acc["end"])).alias("n"))

        return let(pairs, lambda s: F.aggregate(marked(s), zero, add, lambda acc: acc["n"]))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(w) > n, let(hashes, count)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, the counts of the contract and the features, one narrow row a document.

    Null text counts as empty. Rates are per 1000 words; of a text without words they are 0.
    """
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select(key, "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("l"))
    size = F.length("t")
    counts = rows.select(
        key,
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
        (size - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        (size - F.length(F.regexp_replace("t", "[A-Z]", ""))).cast("long").alias("n_upper"),
        (size - F.length(F.regexp_replace("t", "[0-9]", ""))).cast("long").alias("n_digits"),
    )
    rate = lambda a, b="n_words": F.when(F.col(b) > 0, F.col(a) * 1000 / F.col(b)).otherwise(F.lit(0.0))
    return counts.withColumns({
        "word_len": rate("word_chars"), "symbol_rate": rate("n_symbols"), "dup_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words"), "upper_rate": rate("n_upper", "word_chars"), "digit_rate": rate("n_digits", "word_chars"), "line_len": rate("word_chars", "n_lines"),
    })


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained on the covered positives, as FOIL counts it."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, target: str = "bad", features: tuple[str, ...] = FEATURES) -> list[Rule]:
    """Grow and prune rules for rows whose target is 1; no or one-sided labels: no rules.

    The list's size is a setting of the model: at most MAX_RULES rules of at most MAX_TESTS tests, each test
    at one of BINS - 1 quantiles of its feature. All labelled rows take part in every count.

    Deterministic: rows are split by a hash of their features, ties go to the first feature and threshold.
    """
    marks = labelled.agg(*[F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 10_000).alias(f) for f in features]).first()
    cuts = {f: sorted({float(v) for v in marks[f]}) if marks[f] else [] for f in features}
    bins = [F.lit(0) if not cuts[f] else sum((F.col(f) > v).cast("int") for v in cuts[f]) for f in features]
    split = F.pmod(F.xxhash64(*features), F.lit(3))
    left = written(labelled.select(F.col(target).cast("int").alias("y"), *features, F.array(*bins).alias("bins"), (split > 0).alias("grow")), "labelled")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        tests: list[Test] = []
        cover = F.lit(True)
        while len(tests) < MAX_TESTS:
            rows = left.where(F.col("grow") & cover).select("y", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
            table = {(r["f"], r["b"]): (r["p"], r["n"] - r["p"]) for r in rows}
            p0, n0 = (sum(v[k] for (f, _), v in table.items() if f == 0) for k in (0, 1))
            if not p0 or not n0:
                break
            best: tuple[float, Test | None] = (1e-9, None)
            for f, feature in enumerate(features):
                for above in (True, False):
                    for k, value in enumerate(cuts[feature]):
                        side = [v for (g, b), v in table.items() if g == f and (b > k) == above]
                        gain = _gain(sum(v[0] for v in side), sum(v[1] for v in side), p0, n0)
                        if gain > best[0]:
                            best = (gain, Test(feature, above, value))
            if best[1] is None:
                break
            tests.append(best[1])
            cover = cover & best[1].column()
        if not tests:
            break
        heads = [Rule(tuple(tests[: k + 1]), 0, 0) for k in range(len(tests))]
        row = left.where(~F.col("grow")).agg(*[x for k, r in enumerate(heads) for x in (F.sum(F.when(r.column(), F.col("y"))).alias(f"p{k}"), F.count(F.when(r.column(), 1)).alias(f"n{k}"))]).first()
        worth = [((row[f"p{k}"] or 0) / row[f"n{k}"] if row[f"n{k}"] else 0.0, row[f"n{k}"]) for k in range(len(heads))]
        k = max(range(len(heads)), key=lambda k: (round(worth[k][0], 3), worth[k][1], -k))
        if worth[k][0] < MIN_PRECISION or worth[k][1] < MIN_ROWS:
            break
        rules.append(Rule(heads[k].tests, *worth[k]))
        left = left.where(~rules[-1].column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional: the number of the first rule that fires, or null."""
    out = None
    for k, r in enumerate(rules, 1):
        out = F.when(r.column(), F.lit(k)) if out is None else out.when(r.column(), F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) per document.

    All labelled rows are used: a document is bad if its smallest non-null quality is 0. Statistics are
    computed once and written (numbers only). Null or empty text fails the base rule. Repeated rows get
    a row each; without labels only the base rule decides; other columns are ignored.
    """
    stats = written(statistics(docs, key), "statistics")
    bad = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((1 - F.least(F.min("quality"), F.lit(1))).alias("bad"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    rules = learn(stats.where(~failed).join(bad.withColumnRenamed("doc_id", key), key))
    out = stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
