"""Court precedents: pages into citations with principles, article references, overrulings and relations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .legal import citation, western

#: Courts by authority (fixed values), the highest first.
COURTS = ["دستورية", "هيئة_عامة_نقض", "توحيد_مبادئ", "نقض", "ادارية_عليا"]
LEAST = 0.4
SHORT, LONG = 20, 700

_CITED = re.compile(r"[(\[«]([^()\[\]«»]*(?:قرار|أساس)[^()\[\]«»]*)[)\]»]")
_ARTICLE = re.compile(r"(?:المادة|المادتين|المواد)\s*[/(]?\s*([\d٠-٩]+)\s*[/)]?\s*(?:من\s+(?:ال)?(قانون\s+[ء-ي]+(?:\s+(?!المادة|المواد)ال[ء-ي]+)?))?")
_OVERRULED = re.compile(r"(?:العدول|عدلت|نعدل)\s+عن\s+[^.]*?قرار\s*(?:رقم)?\s*([\d٠-٩]+)(?:[^.]*?أساس\s*(?:رقم)?\s*([\d٠-٩]+))?")


def principle_before(text: str) -> str | None:
    """The last paragraph before a citation, if it has a principle's length."""
    paragraphs = [p.strip(" \t-–:") for p in text.split("\n") if p.strip()]
    return paragraphs[-1] if paragraphs and SHORT <= len(paragraphs[-1]) <= LONG else None


def cited(text: str | None) -> list[dict]:
    """A page's citations in order, each once, with the first principle found for it."""
    found: dict[str, dict] = {}
    at = 0
    for m in _CITED.finditer(text or ""):
        c = citation(m[1])
        if c["confidence"] >= LEAST:
            key = c["key"] or m[1]
            one = found.setdefault(key, c | {"raw": m[1], "principle": None})
            one["principle"] = one["principle"] or principle_before(text[at : m.start()])
        at = m.end()
    return list(found.values())


def article_references(text: str | None) -> list[tuple[int, str | None, float]]:
    """(article, law, confidence): sure where the law is named."""
    return [(int(western(m[1])), m[2], 0.9 if m[2] else 0.4) for m in _ARTICLE.finditer(text or "")]


def overrulings(text: str | None) -> list[tuple[int, int | None]]:
    """(number, basis) of each decision a text departs from."""
    return [(int(western(m[1])), int(western(m[2])) if m[2] else None) for m in _OVERRULED.finditer(text or "")]


def authority(court: Column) -> Column:
    """The rank of a court, 1 for the highest; unknown courts come last."""
    ranks = F.create_map(*(F.lit(x) for i, c in enumerate(COURTS) for x in (c, i + 1)))
    return F.coalesce(F.element_at(ranks, court), F.lit(len(COURTS) + 1))


CITATIONS = "url string, place int, raw string, court string, number long, basis long, year int, key string, confidence double, principle string"


def parse_pages(pages: DataFrame) -> DataFrame:
    """Citations of pages (url, text), in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CITATIONS.split(", ")]
        for batch in batches:
            out = [(url, i, *(c[n] for n in names[2:])) for url, text in zip(batch["url"], batch["text"], strict=True) for i, c in enumerate(cited(text))]
            yield pd.DataFrame(out, columns=names).astype({"place": "int32", "number": "Int64", "basis": "Int64", "year": "Int32"})

    return pages.select("url", "text").mapInPandas(run, CITATIONS)


def decisions(citations: DataFrame) -> DataFrame:
    """One row a decision: fields from its first citation that has them, sources and best confidence."""
    order = F.struct("url", "place")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    keyed = citations.filter("key is not null").groupBy("key")
    return keyed.agg(first("court"), first("number"), first("basis"), first("year"), first("principle"), F.countDistinct("url").alias("sources"), F.max("confidence").alias("confidence"))


def approved(found: DataFrame, confidence: float = 0.7, sources: int = 2) -> DataFrame:
    """Decisions fit for export, in order of authority, and whether they pass unreviewed."""
    fit = found.filter((F.length(F.trim("principle")) >= SHORT) & F.col("number").isNotNull() & (F.col("basis").isNotNull() | F.col("year").isNotNull()))
    marked = fit.withColumn("approved", (F.col("confidence") >= confidence) | (F.col("sources") >= sources))
    return marked.withColumn("rank", authority(F.col("court"))).orderBy("rank", F.desc_nulls_last("year"), "key")


def relations(targets: DataFrame, found: DataFrame) -> DataFrame:
    """Overruling edges: targets (by_key, number, basis) to decisions by number and basis, else by number if only one has it."""
    exact = found.select(F.col("number").alias("n1"), F.col("basis").alias("b1"), F.col("key").alias("exact"))
    alone = found.groupBy(F.col("number").alias("n2")).agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("alone")).filter("c = 1").drop("c")
    joined = targets.join(exact, (F.col("number") == F.col("n1")) & (F.col("basis") == F.col("b1")), "left").join(alone, F.col("number") == F.col("n2"), "left")
    return joined.select("by_key", F.coalesce("exact", "alone").alias("target"), "number", "basis").distinct()
