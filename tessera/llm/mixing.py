"""Mixing sources to target weights by soft membership, in DataFrame operations only.

Domains are classes of the label table: good, poor and toxic documents. A classifier
learned from the labelled documents gives each document a posterior over domains:

1. Features of a text are its distinct words (runs of ASCII letters and digits and of
   characters beyond ASCII, in lower case) and the levels of three shares: marks,
   repeated words and repeated lines. On half of a sample of ``SAMPLE`` labelled
   documents, the least by a hash of the id, the G statistic of each feature's presence
   against the first domain is taken, over distinct texts; the ``SELECTED`` features of
   the greatest G, ``TELLING`` at least, are kept with their log likelihood ratios.
2. A document's score for a domain is the sum of the ratios of its features. The scores
   between ``EDGES`` make a cell, and a cell's posterior is the share of each domain
   among the labelled documents of the sample's other half that fall into it, smoothed
   by ``SMOOTH`` pseudo-documents of the product of its margins. So posteriors are
   calibrated against labels that the ratios haven't seen, noise in labels included.

A document's rate, from 0 to ``MOST``, is how often it enters the mixture. With n
tokens and posterior p, the mixture's expected tokens of domain k are sum(x n p_k). The
rates minimise

    1/2 sum_k (sum(x n p_k) - goal_k)^2 / w_k  +  ridge/2 sum(n (x - 1)^2)

(w_k: the greater of the goal and had_k, the domain's expected tokens at rates 1) by projected gradient steps, whose
only global quantities are the K domain sums: each step is one aggregate over the
stored rows. Steps are measured in tokens, so that a document's step does not depend
on its length. Documents with one posterior thus have one rate, and their tokens are
added up before the steps. The first term's curvature is similar to a stochastic
matrix at most, whose largest eigenvalue is 1, and the step is 1 / (1 + ridge). Steps have
momentum and stop when the sums no longer move.

``targets`` are the domains' weights. The total is such that the domain of the largest
weight needs ``headroom`` times the tokens it has; a domain's goal is its target, or
``SUPPLY`` times its tokens if that is less, as a scarce domain can only be met by
documents that hardly belong to it. Weights outside the cone that the
posteriors span can't be met; ``missed`` names the domains that are off. ``copies``
rounds a rate up or down by a hash of the document, so that the mixture's expected
tokens are as fitted, and ``mix_documents`` gives the mixture itself: each document as
often as its copies say. Texts don't move.

Cases: a null or blank text has no tokens and is scored by its levels alone; a null
label counts as 0; a document with several labels counts for each; without labels
every posterior is even; a domain without labels has the smoothing alone; repeated
rows have equal rates; a null id is hashed as such; an empty table gives an empty
result; other columns are ignored, or carried along by ``mix_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, saved

DOMAINS = ("good", "poor", "toxic")
#: Weights of the domains in the mixture.
TARGETS = {"good": 0.89, "poor": 0.09, "toxic": 0.02}
SAMPLE = 50_000
#: Features kept at most, the slots of their table, and the least G (chance gives it one feature in 45,000).
SELECTED, SLOTS, TELLING = 512, 1 << 13, 18.0
EDGES = (0.5, 2.0, 4.0, 8.0, 16.0)
SMOOTH = 1.0
RIDGE, HEADROOM = 0.001, 1.02
#: A domain is asked for at most so many times its tokens, and no document enters more often than this.
SUPPLY, MOST = 1.25, 4.0
STEPS, STORE_EVERY, STILL = 150, 25, 2e-6
MARKS = "[!?#*$%&|<>]"
REST = range(1, len(DOMAINS))
ALL = range(len(DOMAINS))


def sampled(labels: DataFrame) -> DataFrame:
    """At most ``SAMPLE`` labelled ids with their domain's number, and whether they calibrate."""
    toxic, good = F.coalesce(F.col("toxic"), F.lit(0)) == 1, F.coalesce(F.col("quality"), F.lit(0)) == 1
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.when(toxic, 2).when(good, 0).otherwise(1).alias("k")).distinct()
    order = F.xxhash64("label_id", F.lit("sample"))
    return saved(rows.orderBy(order, "k").limit(SAMPLE).withColumn("calibrates", F.pmod(F.xxhash64("label_id"), F.lit(2)) == 1), "sample")


def _level(part: Column, whole: Column) -> Column:
    """A share's place on a scale of eleven levels, each twice the one before."""
    return F.floor(F.log2(1000 * part / F.greatest(whole, F.lit(1)) + 1)).cast("int")


def features(text: Column) -> Column:
    """A text's number of words and the hashes of its features."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.lower(whole), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    lines = F.array_remove(F.split(whole, r"\s*\n\s*"), "")
    repeated_lines = let(lines, lambda x: _level(F.size(x) - F.size(F.array_distinct(x)), F.size(x)))
    marks = _level(F.regexp_count(whole, F.lit(MARKS)), F.length(whole))

    def shaped(w: Column) -> Column:
        def found(d: Column) -> Column:
            levels = {"marks": marks, "words": _level(F.size(w) - F.size(d), F.size(w)), "lines": repeated_lines}
            return F.struct(F.size(w).cast("long").alias("n"), F.concat(d, F.array(*(F.xxhash64(F.lit(f"level of {name}"), x) for name, x in levels.items()))).alias("f"))

        return let(F.array_distinct(w), found)

    return let(F.transform(words, lambda w: F.xxhash64(w)), shaped)


def _g(a: Column, n_a: float, b: Column, n_b: float) -> Column:
    """The G statistic of a feature's presence in ``a`` of ``n_a`` and ``b`` of ``n_b`` documents."""
    share = (a + b) / F.lit(n_a + n_b)
    term = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    return 2 * (term(a, n_a * share) + term(n_a - a, n_a * (1 - share)) + term(b, n_b * share) + term(n_b - b, n_b * (1 - share)))


def learn(docs: DataFrame, sample: DataFrame) -> list[dict]:
    """The telling features, the most telling first: hash ``f`` and log likelihood ratios ``r1``, ... (0: not telling)."""
    half = sample.filter("not calibrates").drop("calibrates")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(F.broadcast(half), "label_id")
    # One row a text: copies of a text aren't independent.
    known = saved(rows.select("k", F.xxhash64(text).alias("h"), features(F.col("text"))["f"].alias("f")).dropDuplicates(["k", "h"]), "known")
    n = {r["k"]: float(r["n"]) for r in known.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = known.select("k", F.explode("f").alias("f")).groupBy("f").agg(*(F.count_if(F.col("k") == k).cast("double").alias(f"c{k}") for k in ALL))
    first, found = n.get(0, 0.0), counts
    for k in REST:
        c, own = F.col(f"c{k}"), n.get(k, 0.0)
        p = (c + F.col("c0")) / F.lit(max(own + first, 1.0))
        ratio = F.log((c + p) / F.lit(own + 1.0)) - F.log((F.col("c0") + p) / F.lit(first + 1.0))
        g = _g(c, own, F.col("c0"), first) if own and first else F.lit(0.0)
        found = found.withColumn(f"g{k}", g).withColumn(f"r{k}", F.when(F.col(f"g{k}") >= TELLING, F.round(ratio, 6)).otherwise(0.0))
    top = F.greatest(*(F.col(f"g{k}") for k in REST))
    best = found.withColumn("g", F.round(top, 6)).filter(F.col("g") >= TELLING).orderBy(F.desc("g"), "f").limit(SELECTED)
    return [r.asDict() for r in best.select("f", *(f"r{k}" for k in REST)).collect()]


def cells(docs: DataFrame, telling: list[dict]) -> DataFrame:
    """``docs`` without the text, with ``n_tokens`` and ``cell``, the place of its scores between ``EDGES``.

    The features' table has ``SLOTS`` slots, each with at most one feature's whole hash;
    of two in one slot, the more telling one stays.
    """
    table: dict[int, dict] = {}
    for row in telling:
        table.setdefault(row["f"] % SLOTS, row)
    # Literals of a bounded size, folded by the optimizer.
    column = lambda name, kind: F.split(F.lit(",".join(f"{table[s][name]}" if s in table else "0" for s in range(SLOTS))), ",").cast(f"array<{kind}>")
    slot = lambda h: F.pmod(h, F.lit(SLOTS))
    hits = F.filter("_f.f", lambda h: F.get(column("f", "bigint"), slot(h)) == h)

    def score(name: str) -> Column:
        return F.aggregate("_hits", F.lit(0.0), lambda a, h: a + F.get(column(name, "double"), slot(h)))

    rows = docs.withColumn("_f", features(F.col("text"))).withColumn("_hits", hits)
    rows = rows.withColumns({f"_s{k}": score(f"r{k}") for k in REST})
    cell = sum((len(EDGES) + 1) ** (k - 1) * sum((F.col(f"_s{k}") > e).cast("int") for e in EDGES) for k in REST)
    return saved(rows.withColumn("n_tokens", F.col("_f.n")).withColumn("cell", cell).drop("_f", "_hits", "text", *(f"_s{k}" for k in REST)), "cells")


def cell_posteriors(rows: DataFrame, sample: DataFrame) -> dict[int, list[float]]:
    """Each cell's posterior, from the sample's calibrating half: a bounded number of counts."""
    half = sample.filter("calibrates").drop("calibrates")
    known = rows.select(F.col("doc_id").cast("long").alias("label_id"), "cell").join(F.broadcast(half), "label_id")
    bins, count = len(EDGES) + 1, {}
    for r in known.groupBy("cell", "k").agg(F.count(F.lit(1)).alias("n")).collect():
        count[r["cell"], r["k"]] = r["n"]
    every = range(bins ** len(REST))
    total = [1.0 + sum(count.get((c, k), 0) for c in every) for k in ALL]
    prior = [x / sum(total) for x in total]
    digit = lambda c, j: c // bins**j % bins

    def margin(j: int, b: int) -> list[float]:
        n = [sum(count.get((c, k), 0) for c in every if digit(c, j) == b) for k in ALL]
        return [(x + SMOOTH * q) / (sum(n) + SMOOTH) for x, q in zip(n, prior, strict=True)]

    out = {}
    for c in every:
        product = [prior[k] * math.prod(margin(j, digit(c, j))[k] / prior[k] for j in range(len(REST))) for k in ALL]
        n = [count.get((c, k), 0) for k in ALL]
        out[c] = [(x + SMOOTH * q / sum(product)) / (sum(n) + SMOOTH) for x, q in zip(n, product, strict=True)]
    return out


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``cell`` and one posterior a domain: p0, p1, ..."""
    sample = sampled(labels)
    rows = cells(docs, learn(docs, sample))
    known = cell_posteriors(rows, sample)
    names = [f"p{k}" for k in ALL]
    table = docs.sparkSession.createDataFrame([(c, *p) for c, p in known.items()], "cell int, " + ", ".join(f"{n} double" for n in names))
    return rows.join(F.broadcast(table), "cell").select(*rows.columns, *names)


def _sums(rows: DataFrame, weight: str) -> list[float]:
    """The domains' expected tokens under a rate."""
    got = rows.selectExpr(*(f"sum({weight} * n_tokens * p{k}) AS p{k}" for k in ALL)).first()
    return [float(x or 0.0) for x in got]


def _moved(steps: list[tuple[float, ...]], ridge: float) -> str:
    """SQL for a row's point (x, y) after more steps: x the rate, y the rate with momentum, where the gradient is taken.

    The steps are a literal, so that the plan and its compiled code are the same for all of them.
    """
    numbers = ",".join(repr(v) for step in steps for v in step)
    at = lambda j: f"get(cast(split('{numbers}', ',') AS array<double>), i * {len(DOMAINS) + 1} + {j})"
    pull = " + ".join(f"{at(k)} * p{k}" for k in ALL)
    new = f"least({MOST!r}D, greatest(0D, a.y - ({pull} + {ridge!r}D * (a.y - 1D)) / {1.0 + ridge!r}D))"
    move = f"transform(array({new}), v -> struct(v AS x, v + {at(len(DOMAINS))} * (v - a.x) AS y))[0]"
    return f"aggregate(sequence(0, {len(steps) - 1}), struct(x, y), (a, i) -> {move})"


def fit_rates(rows: DataFrame, targets: dict[str, float] | None = None, ridge: float = RIDGE, headroom: float = HEADROOM) -> tuple[DataFrame, dict]:
    """``rows`` (n_tokens, p0, ...) with ``rate``, and the domains' totals: had, target, goal and got.

    A step needs the domain sums of the current point only, so the driver holds K
    numbers; the rates stay in the table, stored every ``STORE_EVERY`` steps.
    """
    weights = [(targets or TARGETS)[d] for d in DOMAINS]
    had = _sums(rows, "1D")
    total = sum(had)
    if not total:
        return rows.withColumn("rate", F.lit(1.0)), {"had": had, "target": had, "goal": had, "got": had}
    lead = max(ALL, key=lambda k: weights[k])
    target = [headroom * had[lead] * w / weights[lead] for w in weights]
    goal = [min(t, SUPPLY * h) for t, h in zip(target, had, strict=True)]
    state = saved(rows.withColumns({"x": F.lit(1.0), "y": F.lit(1.0)}), "rates")
    momentum, since = 1.0, []
    got = sums_y = had
    for _ in range(STEPS):
        pull = [(sums_y[k] - goal[k]) / max(had[k], goal[k]) if had[k] else 0.0 for k in ALL]
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        beta = (momentum - 1) / after
        momentum = after
        since.append((*pull, beta))
        new = _sums(state.selectExpr("*", f"{_moved(since, ridge)}.x AS _new"), "_new")
        sums_y = [g + beta * (g - s) for g, s in zip(new, got, strict=True)]
        still = max(abs(g - s) for g, s in zip(new, got, strict=True)) < STILL * total
        got = new
        if still or len(since) == STORE_EVERY:
            state, since = _stored(state, since, ridge), []
        if still:
            break
    state = _stored(state, since, ridge) if since else state
    return state.withColumnRenamed("x", "rate").drop("y"), {"had": had, "target": target, "goal": goal, "got": got}


def _stored(state: DataFrame, steps: list[tuple[float, ...]], ridge: float) -> DataFrame:
    at = state.selectExpr("*", f"{_moved(steps, ridge)} AS _at")
    return saved(at.withColumns({"x": F.col("_at.x"), "y": F.col("_at.y")}).drop("_at"), "rates")


def missed(info: dict, tolerance: float = 0.02) -> dict[str, float]:
    """The domains whose expected tokens are off their target by more than ``tolerance``, with got / target."""
    found = {d: g / t if t else math.inf for d, g, t in zip(DOMAINS, info["got"], info["target"], strict=True) if g or t}
    return {d: x for d, x in found.items() if abs(x - 1) > tolerance}


def copies(rate: Column, *key: Column) -> Column:
    """A rate rounded up or down by a hash of the key, so that its mean is the rate."""
    u = F.pmod(F.xxhash64(*key, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> tuple[DataFrame, dict]:
    """``docs`` without the text, with tokens, posteriors, rate and copies; and the domains' totals."""
    rows = posteriors(docs, labels)
    # One row a cell: its documents have one posterior, hence one rate.
    masses = rows.groupBy("cell", *(f"p{k}" for k in ALL)).agg(F.sum("n_tokens").alias("n_tokens"))
    fitted, info = fit_rates(saved(masses, "masses"), targets)
    rates = fitted.select(F.col("cell").alias("_cell"), "rate")
    found = rows.join(F.broadcast(rates), F.col("cell") == F.col("_cell")).drop("_cell", "cell")
    return found.withColumn("copies", copies(F.col("rate"), F.col("doc_id"))), info


def mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document's tokens, posteriors, rate and copies."""
    found, _ = rated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return found.select("doc_id", "n_tokens", *(F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", "copies")


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents of the mixture with all their columns, each in as many rows as it has copies."""
    inner = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn, _ = rated(inner, labels, targets)
    drawn = drawn.withColumn("copies", F.col("copies").cast("int")).filter("copies > 0")
    return drawn.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_row.*")
