"""Ranked retrieval: postings, BM25, answers with refusal, and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_tokens

K1, B = 1.2, 0.75


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, token, tf and the document's length dl."""
    tokens = docs.select("doc_id", search_tokens(F.col("text")).alias("t"))
    each = tokens.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("token"))
    return each.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def search(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, score and place of the ``k`` best documents for each question.

    Only postings of words that some question has are kept before they are shuffled;
    the corpus' totals are one row.
    """
    sizes = docs.select(F.size(search_tokens(F.col("text"))).alias("dl")).filter("dl > 0")
    n, avgdl = sizes.agg(F.count(F.lit(1)), F.avg("dl")).first()
    asked = questions.select("item_id", F.explode(F.array_distinct(search_tokens(F.col("text")))).alias("token"))
    kept = postings(docs).join(asked.select("token").distinct(), "token", "left_semi")
    df = kept.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
    scored = kept.join(df, "token").select("token", "doc_id", weight.alias("w")).join(asked, "token").groupBy("item_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def answer(docs: DataFrame, questions: DataFrame, least: int = 2) -> DataFrame:
    """The best document for each question, or a refusal if none or too few of its words match."""
    best = search(docs, questions, 1).select("item_id", "doc_id")
    asked = questions.select("item_id", search_tokens(F.col("text")).alias("tokens"))
    there = docs.select("doc_id", search_tokens(F.col("text")).alias("words"))
    met = best.join(there, "doc_id").join(asked, "item_id").select("item_id", "doc_id", F.size("tokens").alias("asked"), F.size(F.filter("tokens", lambda t: F.array_contains("words", t))).alias("matched"))
    joined = questions.select("item_id").join(met, "item_id", "left")
    answered = F.col("doc_id").isNotNull() & ~((F.col("asked") >= 2) & (F.col("matched") < least))
    return joined.select("item_id", F.when(answered, F.col("doc_id")).alias("doc_id"), F.coalesce("matched", F.lit(0)).alias("matched"), F.when(answered, "answered").otherwise("refused").alias("status"))


def holders(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """item_id and doc_id where a document's text holds a question's text.

    The words of a passage but its first and last stand whole in any text that holds it,
    so documents are found by the rarest of them, in an equality join, and then confirmed.
    Passages of one or two words have no such word; they alone are looked for in every text.
    """
    pieces = F.split("text", " ")
    inner = F.array_remove(F.array_distinct(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))), "")
    asked = questions.select("item_id", F.col("text").alias("passage"), inner.alias("inner"))
    probes = asked.select("item_id", F.explode("inner").alias("word"))
    words = docs.select("doc_id", F.explode(F.array_distinct(pieces)).alias("word")).join(probes.select("word").distinct(), "word", "left_semi")
    df = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarest = probes.join(df, "word", "left").groupBy("item_id").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    near = words.join(rarest, "word").select("item_id", "doc_id").join(asked.drop("inner"), "item_id")
    found = near.join(docs, "doc_id").filter(F.contains(F.col("text"), F.col("passage"))).select("item_id", "doc_id")
    short = asked.filter(F.size("inner") == 0).drop("inner")
    if short.limit(1).count():
        found = found.union(docs.join(short, F.contains(F.col("text"), F.col("passage"))).select("item_id", "doc_id"))
    return found


def evaluate(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """total, found and mrr over the questions whose passage some document holds."""
    found = search(docs, questions, k).select("item_id", "doc_id", "place")
    hit = holders(docs, questions).join(found, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("place").alias("place"))
    return hit.agg(F.count(F.lit(1)).alias("total"), F.count("place").alias("found"), F.round(F.sum(F.coalesce(1.0 / F.col("place"), F.lit(0.0))) / F.count(F.lit(1)), 6).alias("mrr"))
