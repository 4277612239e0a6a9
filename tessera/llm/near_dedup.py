"""Near-duplicate documents by b-bit MinHash, with links confirmed on full sets.

A document's set is its distinct runs of ``SHINGLE`` words, A to Z in lower case.

1. One pass makes each document's set size, a 128-bit hash of the whole set,
   ``MINIMA`` minima, their band keys, and a packed signature of the lowest
   ``BITS`` bits of each minimum.
2. Documents with equal sets form classes; only a class's smallest id goes on, so
   a class of copies, however large, costs one row a document.
3. Candidates share a band key. In two rounds every bucket has one leader, and the
   bucket's other members are paired with it alone; members that are by then in
   one component need no further pairs. What is left over are pairs of members in
   different components. So no bucket's pairs are all made, and none is skipped.
4. A candidate's similarity is estimated in the join itself from the bits that
   agree, corrected for the chance agreement of ``2**-BITS``. Only pairs of at least
   ``LINK`` less 4.5 standard errors come out, and are confirmed on their full sets.
   Leaders' pairs are estimated from a quarter of the signature, the others from all.
5. Links give components by label spreading with pointer jumping.

Texts are stored once, bucketed by id, and joined there without being moved again.
At similarity 0.75 a pair misses all 32 bands of 4 with chance 5e-6.

Cases: null, empty and blank texts have empty sets and are linked with nothing;
fewer than ``SHINGLE`` words count as one run; repeated rows fall into one class
and all come out; a null id is never linked and its component is null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .shared import saved, shared_folder

SHINGLE = 5
MINIMA, BITS = 512, 4
BANDS, ROWS_A_BAND = 32, 4
#: Intersection over union, in hundredths.
LINK = 75
LONGS = MINIMA * BITS // 64
#: Longs of the signature that the leaders' rounds carry.
SHORT = LONGS // 4
#: Characters hashed at once in a worker.
SLICE = 1_000_000

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)

SIGNATURES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]
    + [T.StructField("keys", T.ArrayType(T.LongType()))]
    + [T.StructField(f"s{i}", T.LongType()) for i in range(LONGS)]
)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's set as sorted distinct 64-bit hashes."""
    words = wordhash.Words(texts, lower=True)
    grams = wordhash.windows(words.hash, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:  # the whole sequence as one run
            out.append(wordhash.windows(words.hash[a:b], b - a, seed=b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(texts: list[str | None]) -> dict[str, np.ndarray]:
    """n, h1, h2, keys and s0 to s7 of each text."""
    sets = shingle_sets(texts)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    full = np.flatnonzero(n)
    minima = np.zeros((len(sets), MINIMA), dtype=np.uint32)
    sums = np.zeros((2, len(sets)), dtype=np.uint64)
    if len(full):
        everything = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(n[full])[:-1]])
        sums[0, full] = np.add.reduceat(wordhash.mix(everything + np.uint64(1)), starts)
        sums[1, full] = np.add.reduceat(wordhash.mix(everything ^ np.uint64(0x5851F42D4C957F2D)), starts)
        short = (everything >> np.uint64(32)).astype(np.uint32)
        for j in range(MINIMA):
            minima[full, j] = np.minimum.reduceat(short * _A[j] + _B[j], starts)
    bands = minima[:, : BANDS * ROWS_A_BAND].astype(np.uint64).reshape(len(sets), BANDS, ROWS_A_BAND)
    keys = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS_A_BAND):
        keys = wordhash.mix(keys + bands[:, :, r])
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(sets), LONGS, 64 // BITS)
    packed = np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)
    return {"n": n, "h1": _signed(sums[0]), "h2": _signed(sums[1]), "keys": _signed(keys)} | {f"s{i}": _signed(packed[:, i].copy()) for i in range(LONGS)}


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [t if isinstance(t, str) else None for t in batch["text"]]
        for a, b in wordhash.slices([len(t or "") for t in texts], SLICE):
            found = signatures(texts[a:b])
            found["keys"] = list(found["keys"])
            yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].astype("Int64").to_numpy(dtype=object)} | found)
            del found
        wordhash.trim()


def agreeing(left: str, right: str, longs: int) -> Column:
    """Minima whose retained bits agree, by bit counts over the packed signatures."""
    ones = F.lit(0x1111111111111111)

    def differing(i: int) -> Column:
        x = F.col(f"{left}s{i}").bitwiseXOR(F.col(f"{right}s{i}"))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(any_bit.bitwiseAND(ones))

    return F.lit(longs * 64 // BITS) - reduce(lambda a, b: a + b, (differing(i) for i in range(longs)))


def estimate(left: str, right: str, longs: int = LONGS) -> Column:
    """Similarity from agreeing bits, less the agreement of 2**-BITS by chance."""
    chance = 2.0**-BITS
    return (agreeing(left, right, longs) / (longs * 64 // BITS) - chance) / (1 - chance)


def least(longs: int) -> float:
    """Estimates under this are dropped unconfirmed: 4.5 standard errors under the link."""
    chance = 2.0**-BITS
    p = LINK / 100 + (1 - LINK / 100) * chance
    return LINK / 100 - 4.5 * (p * (1 - p) / (longs * 64 // BITS)) ** 0.5 / (1 - chance)


def _alike(left: str, right: str, longs: int) -> Column:
    sizes = 100 * F.least(f"{left}n", f"{right}n") >= LINK * F.greatest(f"{left}n", f"{right}n")
    return sizes & (estimate(left, right, longs) >= least(longs))


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        left, right = batch["left"].tolist(), batch["right"].tolist()
        keep = np.zeros(len(batch), dtype=bool)
        for a, b in wordhash.slices([len(x) + len(y) for x, y in zip(left, right, strict=True)], SLICE):
            distinct = list(dict.fromkeys(left[a:b] + right[a:b]))
            sets = dict(zip(distinct, shingle_sets(distinct), strict=True))
            for i in range(a, b):
                x, y = sets[left[i]], sets[right[i]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = common > 0 and 100 * common >= LINK * (len(x) + len(y) - common)
        yield batch.loc[keep, ["a", "b"]]
        wordhash.trim()


class _Texts:
    """Texts stored once, bucketed by id, so that joins on the id move only the pairs."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"texts_{uuid.uuid4().hex[:12]}"
        rows = docs.filter("doc_id is not null and text is not null").repartition(n, "doc_id")
        rows.write.bucketBy(n, "doc_id").option("path", shared_folder(spark, "texts")).option("compression", "zstd").saveAsTable(self.name)
        self.table = spark.table(self.name)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are linked; ``a`` may be a leader with many pairs."""
        own = lambda id_, text: self.table.select(F.col("doc_id").alias(id_), F.col("text").alias(text))
        pairs = saved(pairs, "pairs")
        # Leaders' texts stand apart, so that a leader's pairs can be split over tasks.
        leaders = saved(own("a", "left").join(pairs.select("a").distinct(), "a", "left_semi"), "leaders")
        return pairs.join(own("b", "right"), "b").join(leaders, "a").select("a", "b", "left", "right").mapInPandas(_confirm, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """The smallest id reachable from each id that has a link: doc_id, component."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = saved(edges.union(edges.select("v", "u")).filter("u <> v").distinct(), "links")
    labels = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("l")).select(F.col("u").alias("doc_id"), "l"), "labels")
    while True:
        near = both.join(labels.select(F.col("doc_id").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        spread = labels.join(near, labels["doc_id"] == near["u"]).select("doc_id", F.least("l", "m").alias("m"), F.col("l").alias("was"))
        jump = labels.select(F.col("doc_id").alias("m"), F.col("l").alias("far"))
        new = saved(spread.join(jump, "m", "left").select("doc_id", F.least("m", "far").alias("l"), "was"), "labels")
        changed = new.filter("l <> was").limit(1).count()
        labels = new.select("doc_id", "l")
        if not changed:
            return labels.select("doc_id", F.col("l").alias("component"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links: only the components that these join are worked on."""
    new = links.select(F.col("a").alias("doc_id")).union(links.select(F.col("b").alias("doc_id"))).distinct()
    every = saved(labels.unionByName(new.join(labels, "doc_id", "left_anti").withColumn("component", F.col("doc_id"))), "labels")
    side = lambda id_, name: every.select(F.col("doc_id").alias(id_), F.col("component").alias(name))
    between = links.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct()
    joined = components(between).select(F.col("doc_id").alias("component"), F.col("component").alias("joined"))
    return saved(every.join(joined, "component", "left").select("doc_id", F.coalesce("joined", "component").alias("component")), "labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = saved(rows.mapInPandas(_sign, SIGNATURES), "signatures")
    texts = _Texts(rows)
    full = signed.filter("n > 0 and doc_id is not null")
    # A class of equal sets is known by its 128-bit hash; partial aggregates leave one row a class and task.
    classes = saved(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # Sets of one run link only with equals.
    several = full.filter("n > 1").dropDuplicates(["doc_id", "h1", "h2"])
    reps = saved(several.join(classes.select(F.col("rep").alias("doc_id"), "h1", "h2", "n"), ["doc_id", "h1", "h2", "n"], "left_semi"), "reps")
    near, wide = (["n", *(f"s{i}" for i in range(longs))] for longs in (SHORT, LONGS))
    keyed = reps.select(F.explode("keys").alias("key"), "doc_id")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    buckets = saved(keyed.join(shared, "key").join(reps.select("doc_id", *near), "doc_id"), "buckets")

    def labelled(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return buckets.withColumn("l", F.col("doc_id"))
        return buckets.join(labels, "doc_id", "left").withColumn("l", F.coalesce("component", "doc_id")).drop("component")

    def prefixed(members: DataFrame, id_: str, prefix: str, columns: list[str]) -> DataFrame:
        return members.select(F.col("key").alias(prefix + "key"), F.col("doc_id").alias(id_), F.col("l").alias(prefix + "l"), *(F.col(c).alias(prefix + c) for c in columns))

    apart = (F.col("xkey") == F.col("ykey")) & (F.col("xl") != F.col("yl"))
    labels = None
    for turn in range(2):
        members = labelled(labels)
        # The leader is the least id first, then the least by a hash.
        rank = F.col("doc_id") if turn == 0 else F.xxhash64("doc_id", F.lit(turn))
        leaders = members.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "doc_id", "l", *near)).alias("x")).select("key", "x.*")
        likely = prefixed(members, "b", "y", near).join(prefixed(leaders, "a", "x", near), apart & _alike("x", "y", SHORT)).select("a", "b").distinct()
        found = saved(texts.confirmed(likely), "found")
        labels = components(found) if labels is None else merged(labels, found)
    # What the leaders did not settle: pairs of one bucket in different components.
    members = labelled(labels)
    mixed = members.groupBy("key").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).filter("lo <> hi").select("key")
    left_over = members.join(mixed, "key").select("key", "doc_id", "l").join(reps.select("doc_id", "keys", *wide), "doc_id")
    # A pair of several common bands comes out at the first of them.
    earlier = F.sequence(F.lit(0), F.array_position("xkeys", F.col("xkey")).cast("int") - 1)
    first = F.forall(earlier, lambda i: (F.get("xkeys", i) != F.get("ykeys", i)) | (F.get("xkeys", i) == F.col("xkey")))
    columns = [*wide, "keys"]
    once = apart & (F.col("a") < F.col("b")) & _alike("x", "y", LONGS) & first
    likely = prefixed(left_over, "a", "x", columns).join(prefixed(left_over, "b", "y", columns), once).select("a", "b").distinct()
    found = saved(texts.confirmed(likely), "found")
    if found.limit(1).count():
        labels = merged(labels, found)
    rep_label = labels.select(F.col("doc_id").alias("rep"), "component")
    named = classes.join(rep_label, "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    final = signed.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return final.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, with all its columns."""
    kept = saved(near_duplicates(docs.select("doc_id", "text")).filter("not kept").select("doc_id"), "dropped").select(F.col("doc_id").alias("_id"))
    return docs.join(kept, docs["doc_id"] == kept["_id"], "left_anti")
