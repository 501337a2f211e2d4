"""A lexical index that is refreshed: immutable segments, deletes beside them, merges of small segments.

A refresh compares the hash of every document's input with the one that was
indexed. Only new and changed documents are tokenised, into one new segment;
documents that are gone or changed are named in a table of deletes, and their
postings are left out until a merge. Nothing is written if all is current.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators.index import POST_BYTES, POST_ROWS, Index, checked, post
from sparkloom.storage import Workspace
from sparkloom.versions import Versions

POSTINGS, DOCS, DEAD, WORDS = "term string, doc_id long, dl long, tf long, places array<int>", "doc_id long, hash string, dl long", "segment string, doc_id long", "term string, df long, cf long"
#: Segments of similar size that are kept side by side, and how many times larger the next size is.
SIDE_BY_SIDE, TIMES = 4, 4
#: Bytes of a table for each core under which its rows are dealt out by a shuffle.
SMALL = 64 << 20


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did; ``version`` is the version that now counts."""

    version: int
    inserted: int
    updated: int
    deleted: int
    kept: int
    merged: int

    @property
    def wrote(self) -> bool:
        return bool(self.inserted or self.updated or self.deleted)


def small_together(segments: list[dict]) -> list[dict]:
    """The segments to merge: once over SIDE_BY_SIDE are of one size, these and all smaller ones; half-dead ones too."""
    size = lambda s: next(i for i in range(64) if s["docs"] - s["dead"] < TIMES ** (i + 1))
    crowded = [i for i in range(64) if sum(size(s) == i for s in segments) > SIDE_BY_SIDE]
    out = [s for s in segments if crowded and size(s) <= max(crowded)]
    return out + [s for s in segments if s not in out and 2 * s["dead"] >= s["docs"] > 0]


class SegmentedIndex:
    """An index under a folder. ``refresh`` brings it to the state of a table, ``open`` gives it for searching."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.versions = Versions(spark, root)
        self.spark = spark

    def _each(self, segments: list[dict], part: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema).withColumn("segment", F.lit(""))
        for s in segments:
            out = out.unionByName(self.versions.read(s[part], schema).withColumn("segment", F.lit(s["name"])))
        return out

    def _dead(self, state: dict) -> DataFrame:
        return self.versions.read(state["dead"], DEAD) if state.get("dead") else self.spark.createDataFrame([], DEAD)

    def _live(self, state: dict, part: str, schema: str, segments: list[dict] | None = None) -> DataFrame:
        segments = state.get("segments", []) if segments is None else segments
        rows = self._each(segments, "docs_table" if part == "docs" else part, schema)
        # A segment without dead documents is read as it is.
        return rows.join(checked(self._dead(state)), ["segment", "doc_id"], "left_anti") if any(s["dead"] for s in segments) else rows

    def refresh(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", input_hash: Column | None = None) -> Refreshed:
        """Bring the index to the state of ``docs``: its ids are different and not null; a null text has no tokens but counts.

        ``input_hash`` names what a document's postings depend on; the text's hash by default.
        """
        seen, state = self.versions.latest()
        now = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), (F.sha2(F.coalesce(F.col(text), F.lit("\0")), 256) if input_hash is None else input_hash.cast("string")).alias("hash"))
        was = self._live(state, "docs", DOCS).select("doc_id", F.col("hash").alias("was"), F.col("dl").alias("old_dl"), "segment")
        both = now.select("doc_id", "hash").join(was, "doc_id", "full")
        step = F.when(F.col("segment").isNull(), "inserted").when(F.col("hash").isNull(), "deleted").when(F.col("hash") == F.col("was"), "kept").otherwise("updated")
        plan = self.versions.write(both.select("doc_id", step.alias("step"), "segment", "old_dl"), "plan")
        plan_rows = self.versions.read(plan, "doc_id long, step string, segment string, old_dl long")
        counts = {r["step"]: r["n"] for r in plan_rows.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}
        done = {k: counts.get(k, 0) for k in ("inserted", "updated", "deleted", "kept")}
        if not (done["inserted"] or done["updated"] or done["deleted"]):
            self.versions.drop(plan)
            return Refreshed(seen, merged=0, **done)
        written = []
        try:
            gone = plan_rows.where("step in ('updated', 'deleted')").select("segment", "doc_id")
            of = {r["segment"]: r["n"] for r in gone.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
            segments = [s | {"dead": s["dead"] + of.get(s["name"], 0)} for s in state.get("segments", [])]
            gone_words = self.spark.createDataFrame([], WORDS)
            if of:
                touched = self._each([s for s in state["segments"] if s["name"] in of], "postings", POSTINGS)
                gone_words = touched.join(checked(gone), ["segment", "doc_id"], "left_semi").groupBy("term").agg((-F.count(F.lit(1))).alias("df"), (-F.sum("tf")).alias("cf"))
            dead = self._dead(state).unionByName(gone)
            words = self.versions.read(state["words"], WORDS) if state.get("words") else self.spark.createDataFrame([], WORDS)
            if new := done["inserted"] + done["updated"]:
                fresh = now if new == done["inserted"] and not state.get("segments") else now.join(plan_rows.where("step in ('inserted', 'updated')").select("doc_id"), "doc_id", "left_semi")
                # A small table may be a single split, and is dealt out before it is tokenised; a large one has splits for all cores.
                cores = self.spark.sparkContext.defaultParallelism
                if int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SMALL:
                    fresh = fresh.repartition(2 * cores, "doc_id")
                tokens = fresh.select("doc_id", F.coalesce(T.index_tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
                rows = tokens.mapInArrow(post, POSTINGS)
                bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(POST_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": POST_BYTES}
                before = {k: self.spark.conf.get(k) for k in bounds}
                try:
                    for k, v in bounds.items():
                        self.spark.conf.set(k, v)
                    segment = {"postings": self.versions.write(rows, "postings")}
                finally:
                    for k, v in before.items():
                        self.spark.conf.set(k, v)
                written.append(segment["postings"])
                added = self.versions.read(segment["postings"], POSTINGS)
                sizes = added.groupBy("doc_id").agg(F.first("dl").alias("dl"))
                segment["docs_table"] = self.versions.write(fresh.select("doc_id", "hash").join(sizes, "doc_id", "left").select("doc_id", "hash", F.coalesce("dl", F.lit(0).cast("long")).alias("dl")), "docs")
                written.append(segment["docs_table"])
                segments.append({"name": segment["postings"].rsplit("-", 1)[1], "postings": segment["postings"], "docs": new, "dead": 0, "docs_table": segment["docs_table"]})
                words = words.unionByName(added.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
            words = words.unionByName(gone_words).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
            merging, rest = small_together(segments), []
            state_now = {"segments": segments, "dead": self.versions.write(dead, "dead")}
            written.append(state_now["dead"])
            if merging:
                name = self.versions.write(self._live(state_now, "postings", POSTINGS, merging).drop("segment"), "postings")
                table = self.versions.write(self._live(state_now, "docs", DOCS, merging).drop("segment"), "docs")
                written += [name, table]
                rest = [s for s in segments if s not in merging]
                left = sum(s["docs"] - s["dead"] for s in merging)
                segments = rest + ([{"name": name.rsplit("-", 1)[1], "postings": name, "docs": left, "dead": 0, "docs_table": table}] if left else [])
                state_now["dead"] = self.versions.write(self._dead(state_now).where(F.col("segment").isin([s["name"] for s in rest])), "dead")
                written.append(state_now["dead"])
            state_now |= {"segments": segments, "words": self.versions.write(words, "words")}
            written.append(state_now["words"])
            # The length of all live documents follows from the change: what is gone, and what has come.
            length = state.get("length", 0) - (plan_rows.where("step in ('updated', 'deleted')").agg(F.sum("old_dl").alias("n")).first()["n"] or 0)
            if new:
                length += self.versions.read(segment["docs_table"], DOCS).agg(F.sum("dl").alias("n")).first()["n"] or 0
            state_now |= {"n_docs": done["inserted"] + done["updated"] + done["kept"], "length": length}
            version = self.versions.publish(seen, state_now)
        except BaseException:
            self.versions.drop(*written)
            raise
        finally:
            self.versions.drop(plan)
        return Refreshed(version, merged=len(merging), **done)

    def state(self) -> dict:
        return self.versions.latest()[1]

    def open(self) -> Index:
        """The newest version, for ``operators.index``: it stays as it is while later ones are published."""
        state = self.state()
        words = self.versions.read(state["words"], WORDS) if state.get("words") else self.spark.createDataFrame([], WORDS)
        n = state.get("n_docs", 0)
        return Index(self._live(state, "postings", POSTINGS).drop("segment"), words, n, max(1e-9, state.get("length", 0) / max(1, n)))


#: Indexes of the running application: by name the index, the mark of the table that it was last refreshed from, and what is open.
_shared: dict[tuple[str, str], tuple[SegmentedIndex, tuple, Index]] = {}


def shared_index(docs: DataFrame, name: str) -> Index:
    """The index under this name of the running application, built when it is first asked for and refreshed when ``docs`` (doc_id, text) has changed."""
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, name)
    mark = tuple(docs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).first())
    index = _shared[key][0] if key in _shared else SegmentedIndex(spark, Workspace(spark, "index").root)
    if key not in _shared or _shared[key][1] != mark:
        index.refresh(docs)
        _shared[key] = (index, mark, index.open())
    return _shared[key][2]
