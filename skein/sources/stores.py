"""JSON-lines scans and sinks, a content-addressed snapshot store and a run ledger.

Paths may lie in any store that Spark reads; nothing here opens a file itself.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.gates import Refusal


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines: strict raises on a malformed line, lenient skips it."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def malformed_lines(spark: SparkSession, path: str, schema: str) -> int:
    """How many lines a lenient read leaves out."""
    return spark.read.text(path).filter("trim(value) != ''").filter(F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNotNull()).count()


def append_lines(df: DataFrame, path: str, allowed: dict[str, list[str]] | None = None) -> None:
    """Appends rows, refusing values outside the enumerations of ``allowed``."""
    for column, values in (allowed or {}).items():
        bad = F.when(~F.col(column).isin(values) | F.col(column).isNull(), F.raise_error(F.concat(F.lit(f"{column} not allowed: "), F.coalesce(F.col(column), F.lit("null")))))
        df = df.withColumn(column, F.coalesce(bad.cast("string"), F.col(column)))
    df.write.mode("append").json(path)


def union_all(*frames: DataFrame, fill: str | None = None) -> DataFrame:
    """Union by name of tables whose schemas grew; new text columns are filled in old rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out if fill is None else out.fillna(fill)


def content_id(df: DataFrame) -> str:
    """Digest of the rows whatever their order: a sum of row hashes, and the schema."""
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    total = df.agg(F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return total.select(F.substring(F.sha2(F.concat_ws("|", F.col("s").cast("string"), F.col("n").cast("string"), F.lit(",".join(sorted(df.columns)))), 256), 1, 32).alias("id")).first().id


class SnapshotStore:
    """Snapshots named by their content, with an append-only manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        try:
            self.spark.read.parquet(path)
            return True
        except PySparkException:
            return False

    def snapshot(self, df: DataFrame, note: str = "") -> str:
        sid = content_id(df)
        if not self._exists(f"{self.root}/data/{sid}"):
            df.write.parquet(f"{self.root}/data/{sid}")
            row = [(sid, datetime.now(timezone.utc).isoformat(), note, uuid.uuid4().hex)]
            self.spark.createDataFrame(row, "snapshot_id string, created_at string, note string, entry string").write.mode("append").json(f"{self.root}/manifest")
        return sid

    def read(self, sid: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/data/{sid}")
        if content_id(df) != sid:
            raise Refusal(f"snapshot {sid} does not match its content")
        return df

    def history(self) -> DataFrame:
        return self.spark.read.schema("snapshot_id string, created_at string, note string, entry string").json(f"{self.root}/manifest")

    def verify(self) -> list[str]:
        """Snapshots whose content no longer matches their name."""
        names = [r.snapshot_id for r in self.history().select("snapshot_id").distinct().collect()]
        return sorted(s for s in names if content_id(self.spark.read.parquet(f"{self.root}/data/{s}")) != s)

    def fork(self, sid: str, to: str) -> None:
        self.read(sid).withColumn("_origin", F.lit(sid)).write.mode("errorifexists").parquet(to)


class Ledger:
    """An append-only log of typed run events."""

    SCHEMA = "event string, run_id string, arm string, seed long, axis string, ts string, payload string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, event: str, run_id: str, arm: str, seed: int, axis: str, payload: str = "{}") -> None:
        if not all((event, run_id, arm, axis)) or seed is None:
            raise Refusal("event, run_id, arm, seed and axis are mandatory")
        row = [(event, run_id, arm, seed, axis, datetime.now(timezone.utc).isoformat(), payload)]
        self.spark.createDataFrame(row, self.SCHEMA).write.mode("append").json(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).json(self.path)

    def has(self, run_id: str) -> bool:
        return bool(self.rows().filter((F.col("run_id") == run_id) & (F.col("event") == "result")).limit(1).count())
