"""The corpus pipeline: each stage works on all documents that its predecessor kept.

Toxic documents go, one document of each group of near copies stays, repeated
passages are cut out, documents that hold test items go, and the rest is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bpe import encode_and_decode
from sparkloom.llm.common import tokens_digest, unused
from sparkloom.llm.decontaminate import with_hits
from sparkloom.llm.nearcopies import near_copy_groups
from sparkloom.llm.simhash import simhash_groups
from sparkloom.llm.suffixes import repeated_spans
from sparkloom.llm.toxicity import THRESHOLD, trained, with_score
from sparkloom.storage import Workspace

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; null texts are empty and stay."""
    score = unused(docs, "score")
    return with_score(docs, trained(spark, docs, sf_dir), score).where(F.col(score) < THRESHOLD).drop(score)


def first_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The document with the smallest id of each group; of rows with one id, one. Rows without an id stay."""
    once = docs.where("doc_id is not null")
    if once.groupBy("doc_id").count().where("count > 1").limit(1).count():
        columns = [F.col(f"`{c}`") for c in docs.columns]
        once = once.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct(*columns)).alias("_row")).select("_row.*")
    kept = groups(once).where("doc_id = component_id").select("doc_id").distinct()
    return once.join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group under op8's rule (three words, three bits)."""
    return first_of_each(docs, simhash_groups)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash (op8's rule) and exact similarity (five words, 0.8 or more) link together."""

    def groups(once: DataFrame) -> DataFrame:
        work, kept = Workspace(spark, "fingerprints"), Workspace(spark, "simhash-groups")
        by_bits = kept.put(simhash_groups(once, work=work).select("doc_id", "component_id"), "groups")
        work.drop()
        return near_copy_groups(once, known=by_bits)

    return first_of_each(docs, groups)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or an earlier part of the text, has; documents left blank go.

    A character cut in half by the edge of a passage goes with it. n_chars, where there is one, is counted anew.
    """
    cut = repeated_spans(docs)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.expr("try_validate_utf8(cast(kept as string))"))
    whole = F.coalesce(text, F.translate(F.expr("make_valid_utf8(cast(kept as string))"), "�", ""))
    out = cut.select("doc_id", whole.alias("text"), F.size("spans").alias("n"), "record").where("n = 0 or trim(text) <> ''")
    others = {c: F.col("record").getField(c) for c in docs.columns if c not in ("doc_id", "text")}
    if "n_chars" in others:
        others["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select([others[c].alias(c) if c in others else F.col(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    hits = unused(docs, "hits")
    return with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits).where(F.size(hits) == 0).drop(hits)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with digests of them and of the text decoded from them."""
    coded = encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "ids", *tokens_digest())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("simhash", near_copies),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: SQL can't express the stages; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.put(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
