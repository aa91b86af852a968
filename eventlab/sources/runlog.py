"""The experiment log as two tables: training facts, and backtest facts with their corrections.

Every append of backtest facts writes a folder of its own and then names it in a commit. Readers take the folders
that commits name, so half-written ones are never seen. `RunLog.compact` writes what is still valid of many folders
into one. A commit's folder and the folders that a compaction replaces never change, and the latest value of a KPI is
the same whether it is read from the old folders, the new one or both: appends and compactions may run side by side.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BACKTEST_LOG, KPIS, TRAINING_LOG

COMMIT = "commit string, replaces array<string>"


class RunLog:
    """A log folder. Appends never rewrite earlier files, so writers do not block each other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.training_path = f"{path}/training"
        self.backtest_path = f"{path}/backtest"
        self.commit_path = f"{path}/commits"

    def _exists(self, path: str) -> bool:
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark._jsc.hadoopConfiguration()
        return bool(hadoop_path.getFileSystem(conf).exists(hadoop_path))

    @property
    def training(self) -> DataFrame:
        if not self._exists(self.training_path):
            return self.spark.createDataFrame([], TRAINING_LOG)
        return self.spark.read.schema(TRAINING_LOG).parquet(self.training_path)

    def commits(self) -> list[str]:
        """The commits that no compaction has replaced, oldest first: few, if the log is compacted now and then."""
        if not self._exists(self.commit_path):
            return []
        made = self.spark.read.schema(COMMIT).json(self.commit_path)
        replaced = made.select(F.explode("replaces").alias("commit"))
        return sorted(r["commit"] for r in made.join(replaced, "commit", "left_anti").collect())

    @property
    def backtests(self) -> DataFrame:
        """The logged KPIs, with the commit that brought them."""
        return self._backtests(self.commits())

    def _backtests(self, commits: list[str]) -> DataFrame:
        first = T.StructField("made_by", T.StringType())
        schema = T.StructType([*BACKTEST_LOG.fields, first, T.StructField("commit", T.StringType())])
        if not commits:
            return self.spark.createDataFrame([], schema).drop("made_by")
        paths = [f"{self.backtest_path}/commit={c}" for c in commits]
        found = self.spark.read.schema(schema).option("basePath", self.backtest_path).parquet(*paths)
        # Rows of a compaction keep the commit they came with.
        return found.withColumn("commit", F.coalesce("made_by", "commit")).drop("made_by")

    def _commit(self, rows: DataFrame, after: list[str], replaces: list[str]) -> str:
        """Write the rows, then the commit. A commit sorts behind all those its writer has seen."""
        last = max((int(c.split("-")[0]) for c in after), default=0)
        name = f"{max(time.time_ns(), last + 1):020d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.backtest_path}/commit={name}")
        self.spark.createDataFrame([(name, replaces)], COMMIT).coalesce(1).write.json(f"{self.commit_path}/entry={name}")
        return name

    def append_training(self, rows: DataFrame) -> None:
        """Add runs. Columns the caller lacks are logged as NULL."""
        _conform(rows, TRAINING_LOG).write.mode("append").parquet(self.training_path)

    def append_backtest(self, rows: DataFrame) -> None:
        """Add or replace the KPIs of logged runs; a run without a training row is an error."""
        if not self._exists(self.training_path):
            raise FileNotFoundError(f"no training log at {self.training_path}: append the training rows first")
        unknown = rows.join(self.training.select("run_id"), "run_id", "left_anti").select("run_id").limit(3).collect()
        if unknown:
            raise ValueError(f"no training row for runs {[r['run_id'] for r in unknown]}")
        self._commit(_conform(rows, BACKTEST_LOG), self.commits(), [])

    def compact(self) -> str | None:
        """One folder for all commits so far, with the values that still count: at most one row per run and KPI.

        Returns the commit, or None if there is nothing to do. Old folders stay for those who read them.
        """
        old = self.commits()
        if len(old) < 2:
            return None
        latest = _latest(self._backtests(old)).select("run_id", F.explode(F.array(*[
            F.struct(
                F.col(f"{k}.logged_at"),
                F.col(f"{k}.commit").alias("made_by"),
                *[(F.col(f"{k}.value") if c == k else F.lit(None)).cast("double").alias(c) for c in KPIS],
            )
            for k in KPIS
        ])).alias("_v")).select("run_id", "_v.*").where(F.col("made_by").isNotNull())
        rows = latest.groupBy("run_id", "logged_at", "made_by").agg(*[F.max(k).alias(k) for k in KPIS])
        kept = _conform(rows, BACKTEST_LOG, "made_by")
        return self._commit(kept, old, old)

    def load(self) -> DataFrame:
        """One row per run with its latest logged value of each KPI. Sort by timestamp at the sink.

        Of values logged at one time the later commit counts, and within a commit the larger value.
        """
        latest = _latest(self.backtests).select("run_id", *[F.col(f"{k}.value").alias(k) for k in KPIS])
        return self.training.join(latest, "run_id", "left")


def _latest(rows: DataFrame) -> DataFrame:
    """For every run and KPI the struct of its latest value, time and commit; a time is later than none."""
    def value(kpi: str):
        return F.struct("logged_at", "commit", F.col(kpi).cast("double").alias("value"))

    return rows.groupBy("run_id").agg(*[F.max(F.when(F.col(k).isNotNull(), value(k))).alias(k) for k in KPIS])


def _conform(rows: DataFrame, schema: T.StructType, *others: str) -> DataFrame:
    present = set(rows.columns)
    return rows.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ],
        *others,
    )
