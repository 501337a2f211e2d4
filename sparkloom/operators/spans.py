"""Sections and spans: the citation units of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Markdown sections: id, pos (from 1), level, title (120 characters), text. Text before the first heading is dropped; no heading gives one section."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.col(text_col)), r"\n(#{1,6}) +([^\n]+)", "\u0001$1\u0002$2\u0003")
    parts = F.split(marked, "\u0001")
    some = F.size(parts) > 1
    body = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(
        F.length(F.substring_index(p, "\u0002", 1)).alias("level"),
        F.substring(F.trim(F.substring_index(F.substring_index(p, "\u0003", 1), "\u0002", -1)), 1, 120).alias("title"),
        F.regexp_replace(F.substring_index(p, "\u0003", -1), r"^[ \n]+|[ \n]+$", "").alias("text"),
    ))
    whole = F.array(F.struct(F.lit(1).alias("level"), F.lit("").alias("title"), F.col(text_col).alias("text")))
    return df.select(id_col, F.posexplode(F.when(some, body).otherwise(whole)).alias("pos", "s")).select(id_col, (F.col("pos") + 1).cast("long").alias("pos"), F.col("s.level").cast("long").alias("level"), "s.title", "s.text")


def prose_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Paragraphs (cut at blank lines) with their hash, once for each source: the first place counts."""
    parts = F.filter(F.transform(F.split(F.col(text_col), r"\n\s*\n"), lambda x: F.trim(x)), lambda p: p != "")
    rows = df.select(F.col(id_col).alias("source_id"), F.posexplode(parts).alias("pos", "text"))
    first = rows.groupBy("source_id", T.short_hash(F.col("text")).alias("span_hash")).agg(F.min(F.struct("pos", "text")).alias("first"))
    return first.select("source_id", "span_hash", (F.col("first.pos") + 1).cast("long").alias("pos"), F.col("first.text").alias("text"))


def windows(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """Character windows of text without blocks that must stay whole; the step is size - overlap."""
    if size <= 0:
        raise ValueError("size must be positive")
    step = max(1, size - overlap)
    n = F.length(text_col)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - F.lit(overlap) - 1), F.lit(step))
    return df.select(id_col, text_col, F.posexplode(starts).alias("i", "start")).select(
        id_col, F.col("i").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), F.expr(f"substring({text_col}, start + 1, {size})").alias("text")
    )


def next_page_ranges(df: DataFrame, id_col: str, page: str) -> DataFrame:
    """For outline entries: the first later page that an entry of the same source starts on (exclusive end), or null."""
    w = Window.partitionBy(id_col).orderBy(page).rangeBetween(1, Window.unboundedFollowing)
    return df.withColumn("next_page", F.min(page).over(w))
