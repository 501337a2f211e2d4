"""Tables as JSON lines, for other replicas, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Deletions go first, so that a reader never revives what is gone.
FIRST = "tombstones"


def export_tables(tables: dict[str, DataFrame], path: str, clock: dict[str, str] | None = None, since: object = None, device: str | None = None) -> DataFrame:
    """Write each table as gzipped JSON lines under ``path`` and return the manifest (place, name, rows).

    ``clock`` names a table's column of revisions: with ``since``, only rows from then on are written.
    """
    spark = next(iter(tables.values())).sparkSession
    root = f"{path}/device={device}" if device else path
    manifest = []
    for place, name in enumerate(sorted(tables, key=lambda n: (n != FIRST, n))):
        df = tables[name]
        if since is not None and clock and name in clock:
            df = df.where(F.col(clock[name]) >= F.lit(since))
        df.write.mode("overwrite").option("compression", "gzip").json(f"{root}/{name}")
        manifest.append((place, name, read_table(spark, root, name, df.schema).count()))
    out = spark.createDataFrame(manifest, "place int, name string, rows long")
    out.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return out


def read_table(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """Rows of an exported table; a line that isn't of the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/{name}")


def page(title: str, body: str, front: dict[str, str], relations: str = "") -> F.Column:
    """A Markdown page as a column: frontmatter, title, body, and relations where there are any. Arguments name columns."""
    lines = [F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in front.items()]
    parts = [F.lit("---"), *lines, F.lit("---"), F.concat(F.lit("# "), F.col(title)), F.lit(""), F.col(body)]
    text = F.concat_ws("\n", *parts)
    return F.when(F.size(relations) > 0, F.concat(text, F.lit("\n\n## Relations\n- "), F.array_join(relations, "\n- "))).otherwise(text) if relations else text
