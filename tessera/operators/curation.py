"""Curating a corpus: gates, exclusions, re-identification, resolution of new documents, pruning, coverage.

Documents have doc_id, url, title, text, identity, confidence, status, tier, complete,
articles and sha. Each function gives a new table, or a column with an outcome for
every row, so that each row has exactly one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_arabic, squeeze
from .resolution import wins

LEAST_SCORE = 55


def gate(legal: Column, articles: Column, score: Column) -> Column:
    """Why a page is not saved, or null."""
    return F.when(~legal, "not_legal").when(articles < 1, "no_articles").when(score < LEAST_SCORE, "low_score")


def first_rule(text: Column, rules: list[str]) -> Column:
    """The first of a list of rules, in order, whose folded words a text contains; the list is literal data."""
    folded = squeeze(fold_arabic(F.coalesce(text, F.lit(""))))
    return F.coalesce(*(F.when(F.contains(folded, squeeze(fold_arabic(F.lit(r)))), F.lit(r)) for r in rules), F.lit(None).cast("string"))


def excluded(docs: DataFrame, rules: list[str]) -> DataFrame:
    """``docs`` with excluded titles marked, and the parts of an excluded head with it."""
    marked = docs.withColumn("reason", first_rule(F.col("title"), rules))
    heads = marked.filter("reason is not null").select(F.col("doc_id").alias("part_of"), F.col("reason").alias("head_reason"))
    joined = marked.join(heads, "part_of", "left")
    reason = F.coalesce("reason", "head_reason")
    return joined.withColumn("status", F.when(reason.isNotNull(), "excluded").otherwise(F.col("status"))).withColumn("reason", reason).select(*docs.columns, "reason")


def reidentified(docs: DataFrame) -> DataFrame:
    """New identity and its outcome, for docs with the stored ``identity`` and the found ``new_key``, ``new_source`` and ``new_number``.

    A stored key yields to a title's, but not to one found in the text; a number
    alone is kept as partial.
    """
    old, new, source = F.col("identity"), F.col("new_key"), F.col("new_source")
    outcome = (
        F.when(new.isNull() & old.isNull() & F.col("new_number").isNull(), "no_match")
        .when(new.isNull() & old.isNull(), "partial")
        .when(new.isNull(), "unchanged")
        .when(old.isNull(), "gained")
        .when(old == new, "unchanged")
        .when(source == "preamble", "kept_existing")
        .otherwise("updated")
    )
    rows = docs.withColumn("outcome", outcome)
    return rows.withColumn("identity", F.when(F.col("outcome").isin("gained", "updated"), new).otherwise(old))


def resolved(stored: DataFrame, new: DataFrame) -> DataFrame:
    """What becomes of each new document (url, identity, sha, c) against the stored ones (url, identity, sha, c, status).

    By URL first: equal content is skipped, better content upgrades in place, else it
    is skipped. Then by identity: the winner is active, the loser an alternate. ``c``
    is the candidate struct of ``resolution``.
    """
    same_url = stored.select("url", F.col("sha").alias("url_sha"), F.col("c").alias("url_c"))
    best = Window.partitionBy("identity").orderBy("url")
    rival = stored.filter("status = 'active' and identity is not null").withColumn("r", F.row_number().over(best)).filter("r = 1").select("identity", F.col("url").alias("rival_url"), F.col("c").alias("rival_c"))
    joined = new.join(same_url, "url", "left").join(rival, "identity", "left")
    known = F.col("url_c").isNotNull()
    action = (
        F.when(known & (F.col("sha") == F.col("url_sha")), "skip_same")
        .when(known & wins(F.col("c"), F.col("url_c")), "upgrade")
        .when(known, "skip_not_better")
        .when(F.col("rival_c").isNull(), "insert")
        .when(wins(F.col("c"), F.col("rival_c")), "supersede")
        .otherwise("alternate")
    )
    return joined.select("url", "identity", action.alias("action"), F.when(action == "supersede", F.col("rival_url")).alias("superseded"))


def pruned(docs: DataFrame, foreign: list[str]) -> DataFrame:
    """``docs`` without those that have no articles, foreign titles, or content that an earlier one has, in that order."""
    kept = docs.filter("articles > 0").filter(first_rule(F.col("title"), foreign).isNull())
    first = F.row_number().over(Window.partitionBy(F.coalesce(F.nullif("sha", F.lit("")), F.concat(F.lit("#"), F.col("doc_id").cast("string")))).orderBy("doc_id"))
    return kept.withColumn("_n", first).filter("_n = 1").drop("_n")


def coverage(core: DataFrame, docs: DataFrame) -> DataFrame:
    """Each core instrument (identity) with its best document: active, then complete, then by articles."""
    order = F.struct((F.col("status") != "active").alias("a"), (~F.col("complete")).alias("b"), (-F.col("articles")).alias("c"), F.col("doc_id").alias("doc_id"))
    best = docs.filter("identity is not null").groupBy("identity").agg(F.min(order).alias("x"))
    return core.join(best, "identity", "left").select("identity", F.col("x.doc_id").alias("doc_id"), F.coalesce(~F.col("x.a") & ~F.col("x.b"), F.lit(False)).alias("covered"))


def triage(title: Column, text: Column) -> Column:
    """Why a document has no identity."""
    head = F.coalesce(title, F.lit(""))
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(squeeze(body)) < 200, "too_short")
        .when(head.rlike("مشروع|اقتراح"), "draft")
        .when(head.rlike("فهرس|قائمة"), "index_page")
        .when(body.rlike("رقم"), "numbered_without_year")
        .when(head.rlike("قانون|مرسوم|قرار"), "named_only")
        .otherwise("other")
    )
