"""Import of peers' exports: ids settle first, then references; any order and repetition of exports gives one state.

A peer numbers its rows as it likes. A row's own id follows from its natural key,
so that equal keys of different peers are one row; a key may hold references, so
tables are taken in the order of their dependencies, parents first. What each
peer calls a row is kept in a map, by which references are told. A row whose
parent is not known yet waits and is tried again at each later import. Of several
rows of one key the last by clock counts, of equal clocks that of the later peer
and local id; a deletion counts from its time on, and against rows of that very
time. All of this is a maximum by key, which no order changes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.storage import Workspace
from sparkloom.versions import Versions


@dataclass(frozen=True)
class Table:
    """name, the column of the peer's id, the natural key, the clock, and references (column: table); the schema is that of the peers' rows."""

    name: str
    schema: str
    id: str
    key: list[str]
    clock: str
    refs: dict[str, str] = field(default_factory=dict)


IDS, GONE, GONE_WAITING = "peer string, local string, id long, clock timestamp_ntz", "id long, deleted_at timestamp_ntz", "peer string, local string, deleted_at timestamp_ntz"


def text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


class Replica:
    """The merged state under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, tables: list[Table]) -> None:
        known: set[str] = set()
        for t in tables:
            if not set(t.refs.values()) <= known:
                raise ValueError(f"{t.name} refers to a table that does not come before it")
            known.add(t.name)
        self.spark, self.tables = spark, tables
        self.versions = Versions(spark, root)

    def _part(self, state: dict, part: str, schema: str) -> DataFrame:
        return self.versions.read(state["parts"][part], schema) if part in state.get("parts", {}) else self.spark.createDataFrame([], schema)

    def _schemas(self, t: Table) -> tuple[str, str]:
        """Of rows as peers give them, and of settled rows, whose references are ids."""
        raw = ", ".join(["peer string", "local string", "clock timestamp_ntz", t.schema])
        of = self.spark.createDataFrame([], t.schema).schema
        settled = ", ".join(["id long", "clock timestamp_ntz", "peer string", "local string", *(f"`{f.name}` {'long' if f.name in t.refs else f.dataType.simpleString()}" for f in of)])
        return raw, settled

    def pull(self, peer: str, export: str, rows: dict[str, DataFrame], gone: dict[str, DataFrame]) -> dict[str, int]:
        """Import one export: rows of tables, and deletions (local, deleted_at) by table. How many rows were read, wait and count now.

        An export that was imported before is not read again. Rows with a null id or a null in their key are left out.
        """
        seen, state = self.versions.latest()
        done = state.get("exports", {})
        if export in done.get(peer, []):
            return {"read": 0, "waiting": 0, "rows": 0, "version": seen}
        work = Workspace(self.spark, "pull")
        parts, totals = dict(state.get("parts", {})), {"read": 0, "waiting": 0, "rows": 0}
        written: list[str] = []

        def keep(df: DataFrame, part: str) -> DataFrame:
            parts[part] = self.versions.write(df, part.replace("/", "-"))
            written.append(parts[part])
            return self.versions.read(parts[part], df_schema(df))

        try:
            ids: dict[str, DataFrame] = {}
            for t in self.tables:
                raw, settled = self._schemas(t)
                columns = self.spark.createDataFrame([], t.schema).columns
                new = self.spark.createDataFrame([], raw)
                if t.name in rows:  # written once: what is read here may be costly to make, and it is counted too
                    new = rows[t.name].select(F.lit(peer).alias("peer"), text(t.id).alias("local"), F.col(t.clock).cast("timestamp_ntz").alias("clock"), *[F.col(f"`{c}`") for c in columns])
                    new = new.where(" and ".join(["local is not null", *(f"`{k}` is not null" for k in t.key)])).distinct()
                    new = work.put(new, f"{t.name}-new")
                told = new.unionByName(self._part(state, f"{t.name}/waiting", raw))
                for c, parent in t.refs.items():
                    name = ids[parent].select("peer", F.col("local").alias(f"_l_{c}"), F.col("id").alias(f"_r_{c}"))
                    told = told.withColumn(f"_l_{c}", text(c)).join(name, ["peer", f"_l_{c}"], "left")
                missing = [f"(_l_{c} is not null and _r_{c} is null)" for c in t.refs]
                told = work.put(told.withColumn("waits", F.expr(" or ".join(missing)) if missing else F.lit(False)), f"{t.name}-told")
                if t.refs:
                    waiting = keep(told.where("waits").select("peer", "local", "clock", *columns), f"{t.name}/waiting")
                    totals["waiting"] += waiting.count()
                value = lambda c: F.col(f"_r_{c}") if c in t.refs else F.col(f"`{c}`")  # noqa: E731, B023
                ready = told.where("not waits").select(F.xxhash64(F.lit(t.name), *[value(c).cast("string") for c in t.key]).alias("id"), "clock", "peer", "local", *[value(c).alias(c) for c in columns])
                ready = work.put(ready, f"{t.name}-ready")
                totals["read"] += new.count()
                # What each peer calls a row: its last word counts.
                calls = self._part(state, f"{t.name}/ids", IDS).unionByName(ready.select("peer", "local", "id", "clock"))
                calls = calls.groupBy("peer", "local").agg(F.max(F.struct("clock", "id")).alias("m")).select("peer", "local", F.col("m.id").alias("id"), F.col("m.clock").alias("clock"))
                ids[t.name] = keep(calls, f"{t.name}/ids")
                both = self._part(state, f"{t.name}/rows", settled).unionByName(ready)
                rest = [c for c in both.columns if c not in ("id", "clock", "peer", "local")]
                best = both.groupBy("id").agg(F.max(F.struct("clock", "peer", "local", *rest)).alias("m")).select("id", "m.*")
                totals["rows"] += keep(best.select(both.columns), f"{t.name}/rows").count()
                drops = self._part(state, f"{t.name}/gone-waiting", GONE_WAITING)
                if t.name in gone:
                    drops = drops.unionByName(gone[t.name].select(F.lit(peer).alias("peer"), F.col("local").cast("string").alias("local"), F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at")).where("local is not null and deleted_at is not null"))
                named = work.put(drops.groupBy("peer", "local").agg(F.max("deleted_at").alias("deleted_at")).join(ids[t.name].select("peer", "local", "id"), ["peer", "local"], "left"), f"{t.name}-drops")
                keep(named.where("id is null").select("peer", "local", "deleted_at"), f"{t.name}/gone-waiting")
                dead = self._part(state, f"{t.name}/gone", GONE).unionByName(named.where("id is not null").select("id", "deleted_at"))
                keep(dead.groupBy("id").agg(F.max("deleted_at").alias("deleted_at")), f"{t.name}/gone")
            version = self.versions.publish(seen, {"parts": parts, "exports": done | {peer: sorted([*done.get(peer, []), export])}})
        except BaseException:
            self.versions.drop(*written)
            raise
        finally:
            work.drop()
        return totals | {"version": version}

    def table(self, name: str) -> DataFrame:
        """The rows that count: id, the peer's columns with references as ids. Rows whose parent is deleted go with it."""
        _, state = self.versions.latest()
        t = next(x for x in self.tables if x.name == name)
        rows = self._part(state, f"{name}/rows", self._schemas(t)[1])
        dead = self._part(state, f"{name}/gone", GONE)
        live = rows.join(dead, "id", "left").where("deleted_at is null or clock > deleted_at").drop("deleted_at")
        for c, parent in t.refs.items():
            live = live.join(self.table(parent).select(F.col("id").alias(c)), c, "left_semi") if c in t.key else live.join(self.table(parent).select(F.col("id").alias("_p")), F.col(c) == F.col("_p"), "left").where(f"`{c}` is null or _p is not null").drop("_p")
        return live


def df_schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
