"""The graph's communities kept up to date as spans are removed.

A build deals active relations, their supports and the communities out to buckets
by component, and keeps for each span the buckets that it matters to. A removal
reads only the buckets of its spans: supports that cite a removed span are stale,
relations without another lineage are no longer active, and only components
that have lost a relation are connected anew. What stays is copied within its
bucket; buckets that the removal doesn't touch are named again by the new
version and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.components import connected_components
from sparkloom.operators.index import checked
from sparkloom.storage import Workspace
from sparkloom.versions import Versions

#: Buckets of a build.
BUCKETS = 64
EDGES = "edge_id long, src long, dst long, authored boolean, component long, bucket int"
SUPPORTS = "edge_id long, support long, lineage long, span long, component long, bucket int"
REPORTS = "community string, component long, members long, relations long, bucket int"


def set_number(value: Column) -> list[Column]:
    """Two sums of a set's elements, by which sets are told apart without a list of them in one place."""
    digest = F.md5(value.cast("string"))
    return [F.sum(F.conv(F.substring(digest, k, 8), 16, 10).cast("long")) for k in (1, 9)]


def reported(edges: DataFrame, supports: DataFrame, config: str) -> DataFrame:
    """The communities of active relations: two nodes or more, and a support that is not an author's.

    The key is that of the members, the supports of extracted relations, the authored relations and the configuration.
    """
    nodes = edges.select("bucket", "component", F.col("src").alias("node")).unionByName(edges.select("bucket", "component", F.col("dst").alias("node"))).distinct()
    m1, m2 = set_number(F.col("node"))
    members = nodes.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("members"), m1.alias("m1"), m2.alias("m2"))
    a1, a2 = set_number(F.col("edge_id"))
    of_edges = edges.groupBy("component").agg(F.count(F.lit(1)).alias("relations"))
    authored = edges.where("authored").groupBy("component").agg(a1.alias("a1"), a2.alias("a2"))
    extracted = supports.join(edges.where("not authored").select("edge_id"), "edge_id", "left_semi").select("component", "edge_id", "support").distinct()
    s1, s2 = set_number(F.concat_ws(":", "edge_id", "support"))
    cited = extracted.groupBy("component").agg(s1.alias("s1"), s2.alias("s2"))
    rows = members.where("members >= 2").join(cited, "component").join(of_edges, "component").join(authored, "component", "left")
    key = F.substring(F.sha2(F.concat_ws("|", "m1", "m2", "s1", "s2", F.coalesce("a1", F.lit(0)), F.coalesce("a2", F.lit(0)), F.lit(config)), 256), 1, 12)
    return rows.select(F.concat(F.lit("comm-"), key).alias("community"), "component", "members", "relations", "bucket")


class LiveGraph:
    """Communities under a folder that all executors share: ``build`` makes the first version, ``remove`` the next ones."""

    def __init__(self, spark: SparkSession, root: str, config: str = "", buckets: int = BUCKETS) -> None:
        self.spark, self.config, self.buckets = spark, config, buckets
        self.versions = Versions(spark, root)

    def _read(self, state: dict, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of these buckets (of all, if none are named); no other folder is opened."""
        want = state["buckets"].keys() if buckets is None else [str(b) for b in buckets]
        folders = [f"{self.versions.root}/{state['buckets'][b][table]}/part={b}" for b in want if table in state["buckets"].get(b, {})]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders).select(schema_names(schema))

    def _write(self, rows: dict[str, DataFrame], old: dict, touched: list[int], work: Workspace) -> dict:
        """The state after writing the touched buckets' rows to new folders."""
        buckets = {b: v for b, v in old.get("buckets", {}).items() if int(b) not in touched}
        for table, df in rows.items():
            kept = work.put(df, f"out-{table}")
            folder = self.versions.write(kept.withColumn("part", F.col("bucket")).repartition("part"), table, "part")
            for r in kept.select("bucket").distinct().collect():
                buckets.setdefault(str(r["bucket"]), {})[table] = folder
        return old | {"buckets": buckets}

    def build(self, relations: DataFrame, supports: DataFrame) -> int:
        """From relations (edge_id, src, dst, authored) and verified supports (edge_id, support, lineage, span: a row for each span).

        A relation is active if it is authored or has a support, and its ends differ.
        """
        seen, _ = self.versions.latest()
        work = Workspace(self.spark, "build")
        proof = supports.select("edge_id").distinct().withColumn("proof", F.lit(True))
        active = work.put(relations.where("src <> dst").join(proof, "edge_id", "left").where("authored or proof").select("edge_id", "src", "dst", "authored"), "active")
        parts = connected_components(active, work, "src", "dst")
        bucket = F.pmod(F.xxhash64("component"), F.lit(self.buckets)).cast("int")
        edges = work.put(active.join(parts.withColumnRenamed("node", "src"), "src").withColumn("bucket", bucket).select(schema_names(EDGES)), "edges")
        cited = work.put(supports.join(edges.select("edge_id", "component", "bucket"), "edge_id").select(schema_names(SUPPORTS)), "supports")
        state = self._write({"edges": edges, "supports": cited, "reports": reported(edges, cited, self.config)}, {}, [], work)
        of_span = cited.select("span", F.col("bucket").alias("holds"), F.pmod(F.xxhash64("span"), F.lit(self.buckets)).cast("int").alias("bucket")).distinct()
        state["spans"] = self.versions.write(of_span.repartition("bucket"), "spans", "bucket")
        version = self.versions.publish(seen, state)
        work.drop()
        return version

    def remove(self, spans: DataFrame) -> dict[str, int]:
        """Take spans (span) out: the next version. What was measured on the way is returned; nothing is written if no support cites them."""
        seen, state = self.versions.latest()
        work = Workspace(self.spark, "remove")
        gone = work.put(spans.select(F.col("span").cast("long").alias("span")).distinct(), "gone")
        index = self.versions.read(state["spans"], "span long, holds int, bucket int")
        parts = [r[0] for r in gone.select(F.pmod(F.xxhash64("span"), F.lit(self.buckets)).cast("int").alias("bucket")).distinct().collect()]
        touched = sorted(r[0] for r in index.where(F.col("bucket").isin(parts)).join(checked(gone), "span", "left_semi").select("holds").distinct().collect())
        supports, edges = self._read(state, "supports", SUPPORTS, touched), self._read(state, "edges", EDGES, touched)
        stale = work.put(supports.join(checked(gone), "span", "left_semi").select("edge_id", "support", "component").distinct(), "stale")
        measured = {"stale_supports": stale.count(), "buckets_read": len(touched)}
        if not measured["stale_supports"]:
            return measured | {"relations_lost": 0, "components_cut": 0, "built": 0, "retired": 0, "version": seen}
        left = work.put(supports.join(stale, ["edge_id", "support"], "left_anti"), "left")
        lost = edges.join(stale.select("edge_id"), "edge_id", "left_semi").join(left.select("edge_id"), "edge_id", "left_anti").where("not authored")
        lost = work.put(lost.select("edge_id", "component"), "lost")
        cut = work.put(lost.select("component").distinct(), "cut")
        rest = work.put(edges.join(lost.select("edge_id"), "edge_id", "left_anti"), "rest")
        again = work.put(rest.join(cut, "component", "left_semi"), "again")
        joined = connected_components(again, work, "src", "dst", "again")
        moved = again.drop("component").join(joined.withColumnRenamed("node", "src"), "src").select(schema_names(EDGES))
        edges_now = work.put(rest.join(cut, "component", "left_anti").select(schema_names(EDGES)).unionByName(moved), "edges-now")
        supports_now = work.put(left.drop("component").join(edges_now.select("edge_id", "component"), "edge_id").select(schema_names(SUPPORTS)), "supports-now")
        # Reports of components without a stale support stay as they are; the others are told by their keys.
        old = self._read(state, "reports", REPORTS, touched)
        hit = stale.select("component").distinct()
        fresh = edges_now.join(hit.join(cut, "component", "left_anti"), "component", "left_semi").unionByName(moved)
        made = work.put(reported(fresh, supports_now.join(fresh.select("edge_id"), "edge_id", "left_semi"), self.config), "made")
        was = work.put(old.join(hit, "component", "left_semi"), "was")
        measured |= {"relations_lost": lost.count(), "components_cut": cut.count()}
        measured |= {"built": made.join(was, "community", "left_anti").count(), "retired": was.join(made, "community", "left_anti").count()}
        reports = old.join(hit, "component", "left_anti").unionByName(made)
        state = self._write({"edges": edges_now, "supports": supports_now, "reports": reports}, state, touched, work)
        measured["version"] = self.versions.publish(seen, state)
        work.drop()
        return measured

    def reports(self) -> DataFrame:
        """community, component, members, relations of the newest version."""
        return self._read(self.versions.latest()[1], "reports", REPORTS).drop("bucket")

    def edges(self) -> DataFrame:
        """The active relations of the newest version, with their components."""
        return self._read(self.versions.latest()[1], "edges", EDGES).drop("bucket")


def schema_names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]
