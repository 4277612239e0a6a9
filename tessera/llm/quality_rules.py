"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each document has signals in thousandths. For each stratum and signal, every
cutoff of a fixed grid is a hypothesis: "this cutoff rejects more than ``risk``
of the good documents". Labelled good documents are the holdout (nothing is fitted
on them), and the exact binomial tail of the rejections seen among them is the
hypothesis' p-value. Cutoffs with p <= ``delta`` / (number of hypotheses) are
certified, by Bonferroni over strata, signals and cutoffs, so with probability
1 - ``delta`` none of them rejects more than ``risk`` of its stratum's good
documents. The strictest certified cutoff is used; a signal without one rejects
nothing. ``risk`` is an allowance for all signals together: each gets its share.

Strata are languages, a null one like an empty one. The table of cutoffs has a row for
each language with a certified cutoff; no hint says how it is joined, so its size and
hot languages are dealt with at run time.

Cases: a null or blank text has no words, fails the base rule and is not kept; a
null id is kept as such; repeated rows get equal verdicts; without labels nothing
is certified and the base rule alone decides; an empty table gives an empty
result; columns other than those named are ignored, or carried along by
``filter_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, saved, words_of

#: Words of a window of the repetition signal.
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Signals in thousandths, each rejecting above a cutoff, with the grids that are tested.
GRIDS = {
    "symbols": [5, 10, 20, 30, 50, 80, 120, 200, 300],
    "dup_lines": [50, 100, 150, 200, 300, 400, 500, 700],
    "repeats": [20, 50, 80, 100, 120, 150, 180],
}
#: Share of a stratum's good documents that all rules together may reject, and the chance of exceeding it.
RISK, DELTA = 0.02, 0.05


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose sequence stands twice or more in the text.

    Windows are told apart by 64-bit hashes within one text. Only texts with a
    repeated window pay for the sort by place.
    """
    size = F.size(hashes)
    grams = F.when(
        size >= WINDOW,
        F.transform(F.slice(hashes, 1, F.greatest(size - (WINDOW - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(found: Column) -> Column:
        def places(pairs: Column) -> Column:
            last = F.size(pairs) - 1
            twin = F.filter(pairs, lambda x, j: ((j > 0) & (F.get(pairs, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(pairs, j + 1)["h"] == x["h"])))
            return F.array_sort(F.transform(twin, lambda x: x["i"]))

        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        add = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(let(ordered, places), start, add, lambda a: a["n"])

    return let(grams, lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found)))


def with_signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one struct column ``_q`` of counts; other columns stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    words = words_of(F.col(text_col))
    counted = docs.withColumn("_w", words).withColumn(
        "_q",
        F.struct(
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            let(F.transform("_w", lambda x: F.xxhash64(x)), _repeat_words).cast("long").alias("n_repeat_words"),
        ),
    )
    return counted.drop("_w")


def permille(part: Column, whole: Column) -> Column:
    return (F.lit(1000) * part / F.greatest(whole, F.lit(1))).cast("long")


def signals(q: Column) -> dict[str, Column]:
    """The signals that cutoffs apply to, from the counts."""
    return {
        "symbols": permille(q["n_symbols"], q["word_chars"]),
        "dup_lines": permille(q["lines"]["dup"], q["lines"]["n"]),
        "repeats": permille(q["n_repeat_words"], q["n_words"]),
    }


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def stratum(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials with chance p, exactly summed in floating point.

    The terms are taken relative to the largest so far, so neither tail underflows:
    log terms follow log t(j+1) = log t(j) + log((n-j)/(j+1)) + log(p/(1-p)).
    """
    odds = F.log(F.lit(p / (1 - p)))
    first = F.struct((n * F.log(F.lit(1 - p))).alias("t"), (n * F.log(F.lit(1 - p))).alias("top"), F.lit(1.0).alias("sum"))

    def add(a: Column, j: Column) -> Column:
        t = a["t"] + F.log((n - j + 1) / j) + odds
        return F.struct(
            t.alias("t"),
            F.greatest(t, a["top"]).alias("top"),
            F.when(t > a["top"], a["sum"] * F.exp(a["top"] - t) + 1.0).otherwise(a["sum"] + F.exp(t - a["top"])).alias("sum"),
        )

    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, first, add, lambda a: F.exp(a["top"]) * a["sum"])
    return F.when(k >= n, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def cutoffs(marked: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The certified cutoff of each stratum and signal: one row a stratum, a null where none is.

    ``marked`` has doc_id, stratum and the signals. The counts of rejected good
    documents come from one aggregate over the labelled rows.
    """
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    held = marked.join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    counts = [F.count_if(F.col(name) > c).alias(f"{name}_{c}") for name, grid in GRIDS.items() for c in grid]
    seen = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    seen = saved(seen, "holdout")
    hypotheses = max(1, seen.count()) * sum(map(len, GRIDS.values()))
    pairs = F.array(*(F.struct(F.lit(name).alias("signal"), F.lit(c).alias("cutoff"), F.col(f"{name}_{c}").alias("k")) for name, grid in GRIDS.items() for c in grid))
    tests = seen.select("stratum", "n", F.explode(pairs).alias("x")).select("stratum", "n", "x.*")
    certified = tests.filter(binomial_tail(F.col("k"), F.col("n"), risk / len(GRIDS)) <= delta / hypotheses)
    return certified.groupBy("stratum").agg(*(F.min(F.when(F.col("signal") == name, F.col("cutoff"))).alias(f"{name}_cutoff") for name in GRIDS))


def judge(signalled: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``signalled`` (from ``with_signals``, materialised) with ``_base_failed`` and ``_kept``."""
    marked = signalled.select(F.col(id_col).cast("long").alias("doc_id"), stratum(stratum_col).alias("stratum"), *(c.alias(n) for n, c in signals(F.col("_q")).items()))
    bounds = cutoffs(marked, labels, risk, delta).withColumnRenamed("stratum", "_s")
    rows = signalled.withColumn("_base_failed", base_failed(F.col("_q")["n_words"], F.col("_q")["n_repeat_words"])).withColumn("_stratum", stratum(stratum_col))
    rejected = [F.coalesce(c > F.col(f"{n}_cutoff"), F.lit(False)) for n, c in signals(F.col("_q")).items()]
    above = rejected[0] | rejected[1] | rejected[2]
    joined = rows.join(bounds, F.col("_stratum") == F.col("_s"), "left")
    return joined.withColumn("_kept", ~F.col("_base_failed") & ~above).drop("_s", "_stratum", *(f"{n}_cutoff" for n in GRIDS))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    stored = saved(with_signals(docs.select("doc_id", "text", "lang")).select("doc_id", "lang", "_q"), "signals")
    q = F.col("_q")
    return judge(stored, labels).select(
        "doc_id", q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["lines"]["dup"].alias("n_dup_lines"),
        q["n_repeat_words"].alias("n_repeat_words"), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
    )


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    inner = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "lang")
    stored = saved(with_signals(inner).select("_row", "_q", "doc_id", "lang"), "signalled")
    return judge(stored, labels).filter("_kept").select("_row.*")
