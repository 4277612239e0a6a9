"""The graph of references between instruments: edges, status, chains, gaps.

Documents have id, identity (kind:number:year), title, year, status, nature and
text. Edges have source_id, target and action. All results are functions of these
tables, made from zero, and every step is a join on an identity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.legal import KINDS, intent, references

EDGES = "source_id long, target string, action string, place int"
BEFORE, AFTER = 160, 60
#: Weights of the kinds of evidence for a missing instrument (fixed values).
WEIGHTS = {"repeal": 5, "article": 4, "amend": 3, "parent": 3, "cite": 1}
IN_FORCE, AMENDED, REPEALED = "in_force", "amended", "repealed"


def active(docs: DataFrame) -> DataFrame:
    return docs.filter((F.col("status") == "active") & (F.coalesce("nature", F.lit("instrument")) == "instrument"))


def edges(docs: DataFrame) -> DataFrame:
    """One row for each instrument that a document names, with what it does to it; none to itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, own, text in zip(batch["id"], batch["identity"], batch["text"], strict=True):
                for n, (key, a, b) in enumerate(references(text)):
                    if key != own:
                        out.append((i, key, intent((text or "")[max(0, a - BEFORE) : b + AFTER]), n))
            yield pd.DataFrame(out, columns=["source_id", "target", "action", "place"]).astype({"place": "int32"})

    return docs.select("id", "identity", "text").mapInPandas(run, EDGES).dropDuplicates(["source_id", "target", "action"])


def legal_status(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each identified document's status by evidence of active instruments no older than it, with the first reasons."""
    by = active(docs).select(F.col("id").alias("source_id"), F.col("title").alias("by"), F.col("year").alias("by_year"))
    evidence = found.filter(F.col("action").isin("repeal", "amend")).join(by, "source_id")
    targets = docs.filter(F.col("identity").isNotNull() & F.col("status").isin("active", "superseded")).select("id", F.col("identity").alias("target"), F.col("year").alias("y"))
    newer = F.col("y").isNull() | F.col("by_year").isNull() | (F.col("by_year") >= F.col("y"))
    reason = F.struct((F.col("action") != "repeal").alias("a"), F.coalesce("by_year", F.lit(0)).alias("b"), F.concat_ws(" ", "action", "by").alias("t"))
    met = targets.join(evidence, "target").filter(newer).groupBy("id").agg(F.max((F.col("action") == "repeal").cast("int")).alias("r"), F.array_sort(F.collect_set(reason)).alias("why"))
    status = F.when(F.col("r").isNull(), IN_FORCE).when(F.col("r") == 1, REPEALED).otherwise(AMENDED)
    return targets.join(met, "id", "left").select("id", F.col("target").alias("identity"), status.alias("legal_status"), F.slice(F.transform("why", lambda x: x["t"]), 1, 3).alias("reasons"))


def chain(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The amending documents of each instrument, in order of year and id."""
    by = active(docs).select(F.col("id").alias("source_id"), "title", "year")
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.asc_nulls_first("year"), "source_id"))
    return found.filter("action <> 'cite'").join(by, "source_id").withColumn("place", place).select("target", "place", "source_id", "title", "year", "action")


def missing_targets(docs: DataFrame, found: DataFrame, limit: int | None = None) -> DataFrame:
    """Instruments that the corpus names and lacks, by weighted evidence; a like number and year is a hint."""
    known = docs.filter("identity is not null").select(F.col("identity").alias("target")).distinct()
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("action"))
    lacking = found.join(known, "target", "left_anti").withColumn("w", F.coalesce(weight, F.lit(1)))
    scored = lacking.groupBy("target").agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("evidence"))
    tail = lambda c: F.substring_index(c, ":", -2)
    like = known.select(tail(F.col("target")).alias("tail"), F.col("target").alias("like")).groupBy("tail").agg(F.min("like").alias("like"))
    ranked = scored.withColumn("tail", tail(F.col("target"))).join(like, "tail", "left").drop("tail").orderBy(F.desc("score"), "target")
    return ranked.limit(limit) if limit else ranked


def queries_for(missing: DataFrame) -> DataFrame:
    """Search strings for missing instruments, by the names of their kinds."""
    part = F.split("target", ":")
    named = {}
    for words, kind in KINDS.items():
        named.setdefault(kind, " ".join(f"ال{w}" for w in words.split()))
    names = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))
    name = F.coalesce(F.element_at(names, F.get(part, F.lit(0))), F.get(part, F.lit(0)))
    return missing.select("target", F.format_string("%s رقم %s لعام %s سوريا نص كامل", name, F.get(part, F.lit(1)), F.get(part, F.lit(2))).alias("query"))
