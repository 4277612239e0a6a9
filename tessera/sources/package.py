"""Packages: rendering, writing with an index, and the integrity gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(index: DataFrame, files: DataFrame) -> DataFrame:
    """Counts of each fault of an index (ipath, isha, ibytes) against files (path, sha, bytes)."""
    listed = index.groupBy("ipath").agg(F.count(F.lit(1)).alias("c"), F.first("isha").alias("isha"), F.first("ibytes").alias("ibytes"))
    j = listed.join(files, F.col("ipath") == F.col("path"), "full")
    there = F.col("ipath").isNotNull() & F.col("path").isNotNull()
    return j.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("listed"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_paths"),
        F.count_if(F.col("path").isNull()).alias("missing"),
        F.count_if(there & (F.col("isha") != F.col("sha"))).alias("wrong_hash"),
        F.count_if(there & (F.col("ibytes") != F.col("bytes"))).alias("wrong_size"),
        F.count_if(F.col("ipath").isNull()).alias("unlisted"),
    )


def file_name(title: Column) -> Column:
    """A safe file name of at most 120 characters."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(title), r'[\\/:*?"<>|\x00-\x1f]', ""), r"\s+", "_")
    return F.when(F.length(clean) > 0, F.substring(clean, 1, 120)).otherwise("document")


def priority(credibility: Column) -> Column:
    return F.when(credibility >= 0.7, 1).when(credibility >= 0.5, 2).otherwise(3)


def as_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


INDEX = ["id", "local_path", "title", "number", "year", "status", "sha256", "bytes"]


def markdown(title: Column, articles: Column) -> Column:
    """A document with its articles (array of number and text) as Markdown."""
    part = F.transform(articles, lambda a: F.concat(F.lit("\n## المادة "), a["number"], F.lit("\n\n"), a["text"], F.lit("\n")))
    return F.concat(F.lit("# "), title, F.lit("\n"), F.array_join(part, ""))


def rendered(docs: DataFrame) -> DataFrame:
    """Documents (id, title, number, year, status, articles) with their file's name, body, hash and size.

    Equal names get ordinal suffixes in order of year, number and id.
    """
    stem = file_name(F.col("title"))
    order = Window.partitionBy("stem").orderBy(F.asc_nulls_first("year"), F.asc_nulls_first("number"), "id")
    named = docs.withColumn("stem", stem).withColumn("n", F.row_number().over(order))
    path = F.concat(F.col("stem"), F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(F.lit("")), F.lit(".md"))
    body = markdown(F.col("title"), F.col("articles"))
    rows = named.withColumn("local_path", path).withColumn("body", body)
    return rows.withColumn("sha256", F.sha2(F.col("body").cast("binary"), 256)).withColumn("bytes", F.octet_length("body")).drop("stem", "n")


def write(docs: DataFrame, path: str) -> None:
    """The package: bodies and index as tables, and a manifest measured from what was written."""
    rows = rendered(docs)
    rows.select("local_path", "body").write.parquet(f"{path}/files")
    rows.select(*INDEX).write.option("header", True).csv(f"{path}/index")
    files = docs.sparkSession.read.parquet(f"{path}/files").select("local_path", F.sha2(F.col("body").cast("binary"), 256).alias("sha"), F.octet_length("body").alias("bytes"))
    total = files.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha")), "").cast("binary"), 256).alias("sha256"))
    total.write.json(f"{path}/manifest")


def index_text(rows: list[tuple]) -> str:
    """An index as one CSV text with a byte-order mark and line feeds, for consumers that want one file."""
    import csv
    import io

    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([INDEX, *rows])
    return "﻿" + out.getvalue()


def merged(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """A destination's index after a merge: our rows replace theirs of the same path and id."""
    return theirs.join(ours.select("local_path", "id"), ["local_path", "id"], "left_anti").unionByName(ours)
