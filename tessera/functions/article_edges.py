"""Edges between articles: which articles of which instrument a text repeals or amends.

A clause is a verb, a list of articles (numbers, ranges, repeated numbers), the word
"of" and an instrument, within one sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .legal import references, western

#: Verbs of each action (fixed values).
_VERB = re.compile(r"(?P<repeal>يلغى|تلغى|ألغيت|إلغاء)|(?P<amend>يعدل|تعدل|تعديل|يستبدل|تستبدل|يستعاض|يضاف|تضاف)")
_LIST = re.compile(r"(?:المادة|المادتين|المادتان|المواد)\s*((?:[\d٠-٩]+|مكرر(?:ة)?|إلى|حتى|[و،,/()\s-])+)\s*من\s+")
_NUMBER = re.compile(r"([\d٠-٩]+)(\s*مكرر(?:ة)?)?(?:\s*(?:إلى|حتى|-)\s*([\d٠-٩]+))?")
#: A range of articles is no longer than this.
RANGE = 60
EDGES = "source_id long, target string, article string, action string"


def numbers(listed: str) -> list[str]:
    """The articles of a list, ranges in full."""
    out = []
    for m in _NUMBER.finditer(western(listed)):
        first, last = int(m[1]), int(m[3]) if m[3] else int(m[1])
        if m[3] and not 0 < first <= last <= first + RANGE:
            last = first
        out += [str(n) for n in range(first, last + 1)] if m[3] else [str(first) + (" مكرر" if m[2] else "")]
    return list(dict.fromkeys(out))


def article_amendments(text: str | None, own: str | None = None) -> list[tuple[str, str, str]]:
    """(target, article, action) of each clause, none on the document's own instrument."""
    found = {}
    for sentence in re.split(r"[.\n؛]", text or ""):
        verb = _VERB.search(sentence)
        while verb:
            after = _VERB.search(sentence, verb.end())
            clause = sentence[verb.end() : after.start() if after else len(sentence)]
            if (listed := _LIST.search(clause)) and (refs := references(clause[listed.end() :])):
                target = refs[0][0]
                if target != own:
                    found |= {(target, n, verb.lastgroup): None for n in numbers(listed[1])}
            verb = after
    return list(found)


def article_edges(docs: DataFrame) -> DataFrame:
    """Article edges of docs (id, identity, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, *e) for i, own, text in zip(batch["id"], batch["identity"], batch["text"], strict=True) for e in article_amendments(text, own)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EDGES.split(", ")])

    return docs.select("id", "identity", "text").mapInPandas(run, EDGES)


def amended_articles(articles: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Articles (identity, article) with what changed them, by documents no older than the target, and their state."""
    by = docs.select(F.col("id").alias("source_id"), F.col("identity").alias("by"), F.col("year").alias("by_year"))
    target = docs.select(F.col("identity").alias("target"), F.col("year").alias("target_year"))
    valid = edges.join(by, "source_id").join(target, "target").filter(F.col("by_year").isNull() | F.col("target_year").isNull() | (F.col("by_year") >= F.col("target_year")))
    one = F.struct("by_year", "by", "action")
    listed = valid.groupBy(F.col("target").alias("identity"), "article").agg(F.array_sort(F.collect_set(one)).alias("amended_by"))
    state = F.when(F.col("amended_by").isNull(), "in_force").when(F.exists("amended_by", lambda x: x["action"] == "repeal"), "repealed").otherwise("amended")
    return articles.join(listed, ["identity", "article"], "left").withColumn("state", state)
