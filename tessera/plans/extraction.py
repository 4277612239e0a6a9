"""Queries over pages and texts that need a parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legal
from ..sources import html
from ..session import table
from .registry import query


@query()
def main_content(spark: SparkSession, d: str) -> DataFrame:
    """Title and content of each page."""
    return html.main_content(table(spark, d, "pages"))


@query()
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    """Each page's links, resolved and distinct."""
    return html.links(table(spark, d, "pages"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval units of at most 1200 characters."""
    return legal.chunk_documents(table(spark, d, "documents")).select("doc_id", "seq", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"))


@query()
def legal_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Identity, articles, dates and references of each document."""
    return legal.legal_columns(table(spark, d, "documents"))
