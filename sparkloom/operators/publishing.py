"""Generations of compiled units: staged, checked, and published by swapping a pointer.

Each scope (a source) has at most one authoritative generation. A round stages
the units of scopes whose content or contract has changed, asks a gate for
violations, and publishes the scopes without any; refused scopes keep the
generation that they had. Readers see a whole round or nothing of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.changes import set_number
from sparkloom.operators.index import checked
from sparkloom.storage import Workspace
from sparkloom.versions import Versions

#: A gate gives the violations of staged units: rows with the scope and a code.
Gate = Callable[[DataFrame], DataFrame]


class Publisher:
    """The published units under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, scope: str, contract: str) -> None:
        self.spark, self.scope, self.contract = spark, scope, contract
        self.versions = Versions(spark, root)
        self.scopes_schema = f"{scope} long, generation long, fingerprint string, units long"

    def scopes(self) -> DataFrame:
        """The authoritative generation of each scope, with its fingerprint and number of units."""
        folder = self.versions.latest()[1].get("scopes")
        return self.versions.read(folder, self.scopes_schema) if folder else self.spark.createDataFrame([], self.scopes_schema)

    def units(self) -> DataFrame | None:
        """The authoritative units of all scopes, with their generation; None before the first round."""
        state, out = self.versions.latest()[1], None
        for generation, (folder, schema) in state.get("units", {}).items():
            rows = self.versions.read(folder, schema).withColumn("generation", F.lit(int(generation)))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out if out is None else out.join(checked(self.scopes().select(self.scope, "generation")), [self.scope, "generation"], "left_semi")

    def publish(self, units: DataFrame, gate: Gate) -> DataFrame:
        """One round: ``units`` is all that the scopes should hold now. The status of each scope is returned.

        published, unchanged (as before, under the same contract), refused, or
        withdrawn (no units any more). Units with a null scope are left out,
        equal units are one. Raises Conflict, with nothing changed, if another
        round was published in between; any other failure changes nothing either.
        """
        s = self.scope
        if "generation" in (c.lower() for c in units.columns):
            raise ValueError("units have a column generation already")
        seen, state = self.versions.latest()
        work = Workspace(self.spark, "publish")
        written: list[str] = []
        try:
            once = units.where(F.col(s).isNotNull()).withColumn(s, F.col(s).cast("long")).distinct()
            a, b = set_number(F.xxhash64(*[F.col(f"`{c}`") for c in once.columns]))
            mark = once.groupBy(s).agg(F.count(F.lit(1)).alias("units"), a.alias("a"), b.alias("b"))
            now = mark.select(s, "units", F.sha2(F.concat_ws("|", F.lit(self.contract), "units", "a", "b"), 256).alias("fingerprint"))
            was = self.scopes().select(s, F.col("fingerprint").alias("was"), F.col("generation").alias("held"), F.col("units").alias("had"))
            step = F.when(F.col("fingerprint").isNull(), "withdrawn").when(F.col("fingerprint") == F.col("was"), "unchanged").otherwise("changed")
            plan = work.put(now.join(was, s, "full").withColumn("step", step), "plan")
            steps = {r["step"] for r in plan.select("step").distinct().collect()}
            if not steps & {"changed", "withdrawn"}:
                return plan.select(s, F.col("step").alias("status"), F.col("held").alias("generation"))
            staged = self.versions.write(once.join(plan.where("step = 'changed'").select(s), s, "left_semi"), "units")
            written.append(staged)
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in once.schema)
            refused = work.put(gate(self.versions.read(staged, schema)).select(F.col(s).cast("long").alias(s)).distinct().withColumn("refused", F.lit(True)), "refused")
            decided = plan.join(refused, s, "left").withColumn("status", F.when(F.col("step") != "changed", F.col("step")).when(F.col("refused"), "refused").otherwise("published"))
            decided = work.put(decided, "decided")
            new = F.col("status") == "published"
            held = decided.where("status <> 'withdrawn' and (status = 'published' or held is not null)")
            held = held.select(s, F.when(new, F.lit(seen + 1).cast("long")).otherwise(F.col("held")).alias("generation"), F.when(new, F.col("fingerprint")).otherwise(F.col("was")).alias("fingerprint"), F.when(new, F.col("units")).otherwise(F.col("had")).alias("units"))
            changed = decided.where("status in ('published', 'withdrawn')").limit(1).count()
            if changed:
                scopes = self.versions.write(held, "scopes")
                written.append(scopes)
                # Folders of generations that no scope holds any more are not named again.
                alive = {r[0] for r in self.versions.read(scopes, self.scopes_schema).select("generation").distinct().collect()}
                folders = {g: f for g, f in ({**state.get("units", {}), str(seen + 1): [staged, schema]}).items() if int(g) in alive}
                self.versions.publish(seen, {"scopes": scopes, "units": folders, "contract": self.contract})
            else:
                self.versions.drop(staged)
            return decided.join(held.select(s, "generation"), s, "left").select(s, "status", "generation")
        except BaseException:
            self.versions.drop(*written)
            raise
