"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in one Arrow batch, and its bytes (a longer row is a batch of its own): documents may be long.
ARROW_ROWS, ARROW_BYTES = 256, "4mb"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Arrow batch of documents holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; other columns can't clash then."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_batches(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """``mapInArrow`` with a function made once for each task; batches that give None are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def annotate(df: DataFrame, name: str, kind: str, make: Callable[[], Callable[[list[str | None]], pa.Array]], text_col: str = "text") -> DataFrame:
    """``df`` with a column made from its texts, in one pass and with no shuffle; the name must be free."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, f(b.column(at).to_pylist())], [*b.schema.names, name])

    return df.mapInArrow(run, df.withColumn(name, F.lit(None).cast(kind)).schema)


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of ``df`` has in any case."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


#: A key is hot if so many of all rows do not even hold one of its rows on average; there are no more hot keys than that.
HOT_KEYS = 1000


def labelled(rows: DataFrame, labels: DataFrame, key: str, members: str) -> DataFrame:
    """``rows`` with the one row of ``labels`` (key, columns, members: how many rows have the key) of each key.

    Keys with over a HOT_KEYS-th of all rows, of which there are HOT_KEYS at
    most, are broadcast, so that no task gets them whole; others are joined by a shuffle.
    """
    least = (labels.agg(F.sum(members).alias("n")).first()["n"] or 0) / HOT_KEYS
    hot, cold = labels.where(F.col(members) > least).drop(members), labels.where(F.col(members) <= least).drop(members)
    few = rows.join(F.broadcast(hot), key)
    return few.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def tokens_digest() -> list[Column]:
    """Digests of the columns ids and decoded."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]
