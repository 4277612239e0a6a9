"""Sharding by minimax contiguous partition, in DataFrame operations only.

Equal texts must share a shard. Documents are ordered by a hash of their text, and
the atomic groups are the ``BUCKETS`` ranges of that order: equal texts never
part, and there are never more groups than ``BUCKETS``, whatever the corpus. The
group sizes are one aggregate; over them the driver binary-searches the smallest
capacity for which a greedy pass needs no more shards than asked, and cuts there.

A greedy pass fills early shards to the brim. The cuts are therefore spread: a
shard ends early at its fair share of what remains, as long as the rest still
fits the capacity. So one huge group does not leave other shards empty.

Places within a shard are gapless: each (bucket, salt) cell has its base from a
running sum over the cells, and a row number within. A cell holds about
``CELL`` rows, or four times a mean bucket's if that is more, since the salts of a
bucket follow its count.

Cases: a null text has no bytes and the checksum of an empty text, and stands with
the empty texts; repeated rows each get a place; an empty table gives an empty
result; a null id sorts first in its cell; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

BUCKETS = 1 << 16
#: Rows that a cell of the place numbering holds, about, before its bucket gets more salts.
CELL = 256
#: Bytes a document counts besides its text.
OVERHEAD = 8


def needed(sizes: list[int], capacity: int) -> int:
    """Shards that a greedy pass over ``sizes`` fills; ``capacity`` holds the largest."""
    shards, used = (1 if sizes else 0), 0
    for size in sizes:
        if used + size > capacity:
            shards, used = shards + 1, 0
        used += size
    return shards


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which ``sizes``, in order, fit into ``shards`` runs."""
    low, high = max(max(sizes, default=0), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if needed(sizes, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def cuts(sizes: list[int], shards: int) -> list[int]:
    """First group of each shard after the first, none over the smallest capacity."""
    capacity = smallest_capacity(sizes, shards)
    n = len(sizes)
    # rest[i]: shards that a greedy pass needs from group i on.
    rest, end, used = [0] * (n + 1), n, 0
    for i in range(n - 1, -1, -1):
        used += sizes[i]
        while used > capacity:
            end -= 1
            used -= sizes[end]
        rest[i] = 1 + rest[end]
    out, left, at = [], sum(sizes), 0
    for k in range(shards, 1, -1):
        used, fair = 0, left / k
        while at < n and used + sizes[at] <= capacity:
            nearer = used and used + sizes[at] - fair > fair - used
            if nearer and rest[at] <= k - 1:
                break
            used += sizes[at]
            at += 1
        left -= used
        out.append(at)
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A shard and a place in it for each document; ``law`` is ``bytes``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.shiftrightunsigned(F.xxhash64(text), 32), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    rows = saved(rows, "sizes")
    # At most BUCKETS rows reach the driver.
    counts = saved(rows.groupBy("bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "groups")
    groups = counts.orderBy("bucket").collect()
    starts = [groups[i]["bucket"] if i < len(groups) else BUCKETS for i in cuts([g["size"] for g in groups], shards)]
    which = F.lit(0)
    for start in starts:
        which = which + (F.col("bucket") >= start).cast("int")
    most = max(CELL, 4 * sum(g["n"] for g in groups) // BUCKETS)
    # Buckets with over four times the mean: fewer than BUCKETS / 4 rows, so they may be broadcast.
    hot = counts.filter(F.col("n") > most).select("bucket", F.ceil(F.col("n") / most).alias("salts"))
    salted = rows.join(F.broadcast(hot), "bucket", "left")
    cell = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "size"), F.col("salts"))).cast("int")
    placed = salted.withColumn("shard", which).withColumn("cell", cell)
    counted = placed.groupBy("shard", "bucket", "cell").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy("bucket", "cell")
    bases = counted.select("bucket", "cell", (F.sum("n").over(order) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("doc_id", "text_crc32")) - 1
    numbered = placed.withColumn("within", within).join(bases, ["bucket", "cell"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
