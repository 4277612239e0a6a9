"""Document fingerprints by closed syncmers, in DataFrame operations only.

A k-mer is ``K`` consecutive words, and its inner substrings are its single words. It is
an anchor if its inner substring with the least hash stands at either edge. That depends
on the k-mer alone, so equal passages have equal anchors wherever they stand. Before the
first word stand ``K`` - 1 marks, greater than any word, so texts of every length have
anchors by one rule, the first of them at the first word. A fingerprint lists each anchor's 32-bit hash together with the distance to the next
anchor: two anchors match only where the next one follows at the same distance, which is
matching by position, indifferent to what was put before them. The likeness of two
fingerprints is the share of their distinct entries that both have.

The edited text of a document ends in the beginning of the next one. Neighbours are
found on the ids alone: ranges of ids, each sorted, and one first id a range. Then
each document meets its successor's text by one join.

Cases: a null text counts as empty; a text without words has an empty fingerprint, alike
(1) to another empty one and unlike (0) all others; a single document follows itself; rows with
one id are ordered by a hash of the text, and exact repeats follow each other; a
null id comes first, as the id -2**63 would; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import let, saved, words_of

K = 8
#: Stands before the first word.
MARK = (1 << 63) - 1


def _short(x: Column) -> Column:
    """The low 32 bits as a signed integer, less 2**31."""
    return (x.bitwiseAND(0xFFFFFFFF) - (1 << 31)).cast("int")


def anchors(text: Column) -> Column:
    """The entries of a text's fingerprint, in order: anchor hash and distance to the next, as 32 bits."""
    marks = F.array_repeat(F.lit(MARK), K - 1)
    marked = lambda h: F.when(F.size(h) > 0, F.concat(marks, h)).otherwise(h)
    return let(let(F.transform(words_of(text), lambda w: F.xxhash64(w)), marked), _syncmers)


def _syncmers(h: Column) -> Column:
    """Entries over a sequence of hashed symbols."""
    # For each k-mer: its place where the least inner hash is the first or the last, else -1.
    starts = F.slice(h, 1, F.greatest(F.size(h) - (K - 1), F.lit(0)))
    closed = lambda x, i: F.array_min(F.slice(h, i + 1, K)).isin(x, F.get(h, i + K - 1))
    places = F.transform(starts, lambda x, i: F.when(closed(x, i), i).otherwise(-1))

    def entries(p: Column) -> Column:
        # The last anchor has no next one: distance 0.
        return F.transform(p, lambda i, j: _short(F.xxhash64(F.slice(h, i + 1, K), F.coalesce(F.get(p, j + 1) - i, F.lit(0)))))

    return let(F.array_remove(places, -1), entries)


def as_string(entries: Column) -> Column:
    """Eight hexadecimal digits an entry."""
    return F.array_join(F.transform(entries, lambda x: F.lower(F.lpad(F.hex(x.cast("long") + (1 << 31)), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Distinct entries in both over distinct entries in either."""

    def of_distinct(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        common = F.size(F.array_intersect(a, b))
        return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1)))

    return let(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), of_distinct)


def successors(keys: DataFrame) -> DataFrame:
    """``keys`` (k, h, copy and more), in that order, with the next row's k and h as nk and nh."""
    own = F.struct("k", "h", "copy")
    ranged = saved(keys.repartitionByRange("k", "h", "copy").withColumn("part", F.spark_partition_id()), "ids")
    inside = Window.partitionBy("part").orderBy("k", "h", "copy")
    rows = ranged.withColumn("next", F.lead(own).over(inside))
    # One row a range of ids, no more than shuffle partitions.
    heads = ranged.groupBy("part").agg(F.min(own).alias("head"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("after"))
    found = rows.join(F.broadcast(after), "part").withColumn("next", F.coalesce("next", "after"))
    return found.drop("part", "after").withColumns({"nk": F.col("next.k"), "nh": F.col("next.h")}).drop("next")


#: Stands for a null id in keys, so that it sorts first and joins.
NO_ID = -(1 << 63)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likenesses."""
    # A text moves once, by its key; the same exchange serves both joins below.
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    groups = saved(rows.groupBy("k", "h").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).alias("n")), "keys")
    if groups.filter("copies > 1").limit(1).count():  # exact repeats of a row share one text
        rows = rows.dropDuplicates(["k", "h"])
    keys = groups.select("k", "h", "n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    follow = successors(keys).withColumn("cut", F.floor(F.col("n") / 4).cast("int")).drop("copy")
    there = rows.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("text").alias("next_text"))
    tails = follow.join(there, ["nk", "nh"]).select("k", "h", "n", "cut", F.expr("substring(next_text, 1, cut)").alias("tail"), anchors(F.col("next_text")).alias("next_entries"))
    both = tails.join(rows, ["k", "h"])
    edited = F.concat(F.expr("substring(text, 1, n - cut)"), F.col("tail"))
    marked = both.select("k", "n", anchors(F.col("text")).alias("entries"), "next_entries", edited.alias("edited"))
    marked = marked.withColumn("edited_entries", anchors(F.col("edited")))
    return marked.select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("entries")).alias("fingerprint"),
        as_string(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )
