"""Documents that are parts of one law, found by equality joins and connected components.

Documents of one number and year, and of one class of kinds, stand in one bucket. An
undated document takes the year of the bucket it matches: it shares a word of its
title with a member, or its articles lie inside a member's and the titles don't name
different subjects. Among several buckets the one of the smallest id counts. An
undated document that found its year is a member that later ones (greater id) can
match; so choices are made again from the last round's until they stay. Those that
match nothing stand by the words of their title.

Inside a bucket, documents are related that share a word of their titles or all words,
or whose wide ranges are nearly the same; a title without words is related to all.
Sharing is reachability through a node for the word, so no pairs are formed for it, and
the parts of a law are the connected components.

Cases: documents without a number or without articles are no parts; a null kind goes
with the bucket's only class, if there is one; a null title has no words; a single
document is a head without parts; repeated ids are one node; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved
from .graph import components

# Words of titles that name no subject.
STOP = """
قانون القانون مرسوم المرسوم التشريعي التشريعى الاشتراعي رقم لعام للعام لسنة عام سنة في من على إلى الجمهورية العربية السورية سورية سوريا
بشأن الخاص المتعلق القاضي القاضى وثيقة قانونية نصوص مواد الصادر بالمرسوم المادة
""".split()
# The least span of a range that lies inside another, of one that holds it, and the share of the wider span that near-identical ranges have in common.
INNER, WIDE, SHARED = 4, 20, 0.8
#: Kinds that go together; regulations are no parts.
CLASSES = {"law": "statute", "legislative_decree": "statute"}
EXCLUDED = "regulation"


def title_words(title: Column) -> Column:
    """The subject's words: four Arabic letters or more, without the article, none of ``STOP``."""
    found = F.filter(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[ء-ي]{4,}"), 0), lambda w: ~w.isin(STOP))
    return F.array_distinct(F.transform(found, lambda w: F.when(w.startswith("ال") & (F.length(w) > 5), F.substring(w, 3, 1 << 20)).otherwise(w)))


def title_stem(title: Column) -> Column:
    """The title without digits and separators."""
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"[\d\s\p{Punct}ـ–—]+", " "))


def _prepared(docs: DataFrame) -> DataFrame:
    kind = F.col("kind").cast("string") if "kind" in docs.columns else F.lit(None).cast("string")
    kept = docs.filter(F.col("number").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.coalesce(kind, F.lit("")) != EXCLUDED))
    named = F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv))
    rows = kept.select("id", "number", "year", "lo", "hi", F.coalesce(F.element_at(named, kind), kind).alias("cls"), title_words(F.col("title")).alias("words"), title_stem(F.col("title")).alias("stem"))
    only = rows.filter("cls IS NOT NULL").groupBy("number").agg(F.min("cls").alias("one"), F.countDistinct("cls").alias("n"))
    found = rows.join(only, "number", "left").withColumn("cls", F.coalesce("cls", F.when(F.col("n") == 1, F.col("one")), F.lit("")))
    return saved(found.drop("one", "n").withColumn("span", F.col("hi") - F.col("lo")), "parts")


def _chosen_years(rows: DataFrame) -> DataFrame:
    """id and the year that each undated document takes."""
    dated = rows.filter("year IS NOT NULL")
    first = dated.groupBy("number", "cls", "year").agg(F.min("id").alias("first"))
    undated = rows.filter("year IS NULL").drop("year")
    chosen = undated.select("id", F.lit(None).cast(rows.schema["year"].dataType).alias("year")).limit(0)
    while True:
        placed = undated.join(chosen, "id").withColumn("before", F.col("id"))
        members = dated.withColumn("before", F.lit(None).cast("long")).unionByName(placed)
        m = members.select("number", "cls", F.col("year").alias("y"), F.col("before"), F.col("words").alias("m_words"), F.col("lo").alias("m_lo"), F.col("hi").alias("m_hi"), F.col("span").alias("m_span"))
        earlier = F.col("before").isNull() | (F.col("before") < F.col("id"))
        by_word = undated.select("id", "number", "cls", F.explode("words").alias("w")).join(m.select("number", "cls", "y", "before", F.explode("m_words").alias("w")), ["number", "cls", "w"]).filter(earlier)
        inside = (F.col("span") >= INNER) & (F.col("m_span") >= WIDE) & (F.col("m_lo") <= F.col("lo")) & (F.col("hi") <= F.col("m_hi")) & (F.col("span") < F.col("m_span"))
        open_ = (F.size("words") == 0) | (F.size("m_words") == 0)
        by_range = undated.filter(F.col("span") >= INNER).join(m.filter(F.col("m_span") >= WIDE), ["number", "cls"]).filter(inside & open_ & earlier)
        found = by_word.select("id", "number", "cls", "y").union(by_range.select("id", "number", "cls", "y"))
        best = found.join(first.withColumnRenamed("year", "y"), ["number", "cls", "y"]).groupBy("id").agg(F.min_by("y", F.struct("first", "y")).alias("year"))
        new = saved(best, "years")
        same = new.join(chosen.withColumnRenamed("year", "was"), "id", "full").filter(~F.col("year").eqNullSafe(F.col("was"))).limit(1).count() == 0
        chosen = new
        if same:
            return chosen


def _edges(rows: DataFrame) -> DataFrame:
    """Relatedness inside buckets (id, number, cls, bucket, words, stem, lo, hi, span): edges of nodes."""
    node = lambda kind, *more: F.xxhash64(F.lit(kind), "number", "cls", "bucket", *more)
    doc = F.xxhash64(F.lit("doc"), "id")
    words = rows.select(doc.alias("a"), "number", "cls", "bucket", F.explode("words").alias("w")).select("a", node("word", "w").alias("b"))
    stems = rows.select(doc.alias("a"), node("stem", "stem").alias("b"))
    # A title without words is related to all of its bucket.
    generic = rows.filter(F.size("words") == 0).select("number", "cls", "bucket").distinct()
    alls = rows.join(generic, ["number", "cls", "bucket"]).select(doc.alias("a"), node("all").alias("b"))
    wide = rows.filter((F.col("span") >= WIDE) & ~F.col("bucket").startswith("title")).withColumn("band", F.floor(F.log("span") / F.log(F.lit(1 / SHARED))))
    # Spans of near-identical ranges are in one band or the next.
    left = wide.select("number", "cls", "bucket", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), doc.alias("a"), "lo", "hi", "span")
    right = wide.select("number", "cls", "bucket", "band", doc.alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("span").alias("span2"))
    close = F.least("hi", "hi2") - F.greatest("lo", "lo2") >= SHARED * F.greatest("span", "span2")
    near = left.join(right, ["number", "cls", "bucket", "band"]).filter((F.col("a") != F.col("b")) & close).select("a", "b")
    return words.union(stems).union(alls).union(near)


def link_parts(docs: DataFrame) -> DataFrame:
    """id, part_of (null for a head) and the year a head may inherit, for docs (id, number, year, title, lo, hi, and kind if known).

    The head has the widest range, then the smallest first article, then the smallest id.
    """
    rows = _prepared(docs)
    chosen = _chosen_years(rows).withColumnRenamed("year", "taken")
    own = F.coalesce(F.col("year"), F.col("taken"))
    bucket = F.coalesce(F.concat(F.lit("year "), own.cast("string")), F.concat(F.lit("title "), F.col("stem")))
    placed = saved(rows.join(chosen, "id", "left").withColumn("bucket", bucket), "placed")
    labels = components(_edges(placed))
    member = placed.withColumn("node", F.xxhash64(F.lit("doc"), "id")).join(labels, "node")
    order = F.struct((F.col("lo") - F.col("hi")).alias("narrow"), "lo", "id")
    heads = member.groupBy("component").agg(F.min_by("id", order).alias("head"), F.collect_set("year").alias("years"), F.countDistinct("id").alias("n"))
    one_year = F.when(F.size("years") == 1, F.get("years", F.lit(0)))
    return member.join(heads.filter("n > 1"), "component").select("id", F.when(F.col("id") != F.col("head"), F.col("head")).alias("part_of"), one_year.cast("int").alias("year")).distinct()


def explained(docs: DataFrame) -> DataFrame:
    """One row a law in parts: its head, its members, their articles from first to last, and its year."""
    linked = link_parts(docs).withColumn("head", F.coalesce("part_of", "id"))
    return linked.join(docs.select("id", "lo", "hi"), "id").groupBy("head").agg(F.sort_array(F.collect_set("id")).alias("members"), F.min("lo").alias("first"), F.max("hi").alias("last"), F.max("year").alias("year"))
