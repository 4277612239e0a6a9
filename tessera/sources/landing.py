"""Readers of what a crawl lands: sitemaps, feeds, archive listings, files and taxonomies.

Fetching is outside the engine: a crawler lands bytes, and these read them with
Spark's own readers, so any path Spark opens will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = "feed struct<entry:array<struct<title:struct<`$t`:string>,content:struct<`$t`:string>,link:array<struct<rel:string,href:string>>>>>"
POSTS = "id long, title struct<rendered:string>, content struct<rendered:string>"


def sitemap_urls(xml: DataFrame, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """source and url of each ``loc`` in sitemaps (source, body), of the given path types only."""
    found = xml.select("source", F.posexplode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("place", "url"))
    if types:
        found = found.filter(F.col("url").rlike("|".join(re.escape(t) for t in types)))
    return (found.filter(F.col("place") < limit) if limit else found).dropDuplicates(["url"]).select("source", "place", "url")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """The sitemaps that robots files (host, body) name, else the usual place."""
    named = F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)
    usual = F.array(F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap.xml")))
    return robots.select("host", F.explode(F.when(F.size(named) > 0, F.slice(named, 1, 2)).otherwise(usual)).alias("sitemap"))


def robots_policy(status: Column, failed: Column) -> Column:
    """401 and 403 deny all, other client errors and network failures allow, else the file's rules hold."""
    return F.when(failed, "allow").when(status.isin(401, 403), "deny").when((status >= 400) & (status < 500), "allow").otherwise("rules")


def feed_posts(spark: SparkSession, path: str) -> DataFrame:
    """url, title and html of the posts of Blogger feeds."""
    entries = spark.read.schema(FEED).option("multiLine", True).json(path).select(F.explode("feed.entry").alias("e"))
    link = F.get(F.filter("e.link", lambda x: x["rel"] == "alternate"), F.lit(0))["href"]
    return entries.select(link.alias("url"), F.col("e.title.`$t`").alias("title"), F.col("e.content.`$t`").alias("html"))


def numbered_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of a REST listing by the number in their title, those without one last."""
    posts = spark.read.schema(POSTS).option("multiLine", True).json(path)
    number = F.nullif(F.regexp_extract("title.rendered", r"(\d+)", 1), F.lit("")).cast("int")
    return posts.select("id", number.alias("number"), F.col("title.rendered").alias("title"), F.col("content.rendered").alias("html")).orderBy(F.asc_nulls_last("number"), "id")


def latest_snapshots(listing: DataFrame) -> DataFrame:
    """The newest good snapshot of each URL (url, timestamp, statuscode)."""
    return listing.filter("statuscode = '200'").groupBy("url").agg(F.max("timestamp").alias("timestamp"))


def thread_map(listing: DataFrame) -> DataFrame:
    """For each thread of forum URLs (url, timestamp): the cleanest URL, then the newest."""
    rows = listing.withColumn("thread", F.regexp_extract("url", r"/t(\d+)", 1)).filter("thread <> ''")
    noise = F.length(F.regexp_replace("url", r"[^?&=%#]", ""))
    best = F.min_by(F.struct("url", "timestamp"), F.struct(noise, -F.col("timestamp").cast("long"), F.length("url"), F.col("url")))
    return rows.groupBy("thread").agg(best.alias("b")).select("thread", "b.*")


def decoded(raw: Column) -> Column:
    """UTF-8 bytes as text, else Windows Arabic."""
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "windows-1256"))


def kind(content: Column) -> Column:
    """What a file is, by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.substring(content, 1, 200).cast("string"))
    starts = lambda magic: F.startswith(head, F.lit(magic))
    return F.when(starts("25504446"), "pdf").when(starts("504B0304"), "zip").when(starts("52617221"), "rar").when(starts("D0CF11E0"), "doc").when(F.contains(text, F.lit("<html")) | F.contains(text, F.lit("<!doctype")), "html").otherwise("unknown")


class Limits(NamedTuple):
    """What one landed file may expand to; what a limit leaves out has a row with an error."""

    members: int = 200
    depth: int = 2
    size: int = 50_000_000


#: The namespace of OOXML word processing, whose main part holds paragraphs (p) of runs of text (t).
WORD_ML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAIN_PART = "word/document.xml"


def _paragraphs(part: bytes) -> str:
    lines = ("".join(t.text or "" for t in p.iter(f"{WORD_ML}t")) for p in ElementTree.fromstring(part).iter(f"{WORD_ML}p"))
    return "\n".join(lines).strip()


def _plain(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("windows-1256", "replace")


def expanded(source: str, raw: bytes, limits: Limits) -> Iterator[tuple[str, str | None, str | None]]:
    """(source, text, error) of a file, or of each member of an archive, named source#member, breadth first."""
    waiting = deque([(source, raw, 0)])
    while waiting:
        name, data, level = waiting.popleft()
        if not data.startswith(b"PK\x03\x04"):
            yield name, _plain(data), None
            continue
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                entries = [e for e in archive.infolist() if not e.is_dir()]
                main = next((e for e in entries if e.filename == MAIN_PART), None)
                if main:
                    yield name, *((None, "TooLarge") if main.file_size > limits.size else (_paragraphs(archive.read(main)), None))
                    continue
                for place, entry in enumerate(entries):
                    inner = f"{name}#{entry.filename}"
                    error = "TooDeep" if level >= limits.depth else "TooMany" if place >= limits.members else "TooLarge" if entry.file_size > limits.size else None
                    if error:
                        yield inner, None, error
                    else:
                        waiting.append((inner, archive.read(entry), level + 1))
        except (zipfile.BadZipFile, ElementTree.ParseError, RuntimeError, NotImplementedError) as e:
            yield name, None, type(e).__name__


def file_texts(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """source, text and error of landed files (path, content); archives expand to their members within ``limits``.

    Cases: null content is an empty text; a broken archive, or a member that a limit
    leaves out, has a null text and an error; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                found = list(expanded(path, bytes(raw) if raw is not None else b"", limits))
                yield pd.DataFrame(found, columns=["source", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "source string, text string, error string")


def laws_with_articles(laws: DataFrame, articles: DataFrame) -> DataFrame:
    """Each law with its articles in order, those without any included."""
    one = F.struct(F.expr("try_cast(regexp_extract(article_number, '^\\\\s*([0-9]+)', 1) as int)").alias("n"), "article_number", "text")
    grouped = articles.groupBy(F.col("law_id").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("articles"))
    return laws.join(grouped, "id", "left").withColumn("articles", F.coalesce("articles", F.array().cast(grouped.schema["articles"].dataType)))
