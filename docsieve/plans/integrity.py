"""One audit entry per document, checked run by run against a merged state.

The book holds, per document id, how many documents and audit entries all runs brought, in buckets by hash of the id.
A run reads its own rows once, and of the state only the buckets it touches; their merged rows are written to a folder
of the run's own, and one small commit row per bucket then makes them current. So a run that broke off before its
commit changed nothing for readers, and a run committed before is not counted twice. One writer at a time.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.session import remove_path, stage, staging_path

_STATE = "document_id string, documents bigint, audit_entries bigint"
_COMMITS = "run_id string, place int, bucket int, folder string, committed_at double"


class IntegrityBook:
    """``buckets`` bounds what the driver is told of a run, and is fixed when the book is begun."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _COMMITS)

    def _folders(self, buckets: set[int] | None = None) -> list[str]:
        """The current folder of each bucket, or of the given ones."""
        last = self.commits().groupBy("bucket").agg(F.max_by("folder", "place").alias("folder")).collect()
        return [r.folder for r in last if r.folder and (buckets is None or r.bucket in buckets)]

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(*folders)

    def state(self) -> DataFrame:
        return self._read(self._folders())

    def breaches(self) -> DataFrame:
        """Documents that do not have exactly one audit entry, and entries without a document, over all runs."""
        return self.state().where("documents <> 1 or audit_entries <> 1")

    def _commit(self, run_id: str, place: int, folders: list[tuple[int, str]]) -> None:
        rows = [(run_id, place, bucket, folder, time.time()) for bucket, folder in folders] or [
            (run_id, place, -1, "", time.time())]
        self.spark.createDataFrame(rows, _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def add_run(self, run_id: str, documents: DataFrame, audit: DataFrame, key: str = "document_id") -> DataFrame:
        """Merge a run and return the breaches among the ids of the buckets it touched."""
        known = self.commits().agg(F.max("place"), F.bool_or(F.col("run_id") == run_id)).first()
        if known[1]:
            touched = {r.bucket for r in self.commits().where(F.col("run_id") == run_id).select("bucket").collect()}
            return self._read(self._folders(touched)).where("documents <> 1 or audit_entries <> 1")
        tagged = (documents.select(F.col(key).cast("string").alias("document_id"), F.lit(1).alias("d"), F.lit(0).alias("a"))
                  .unionByName(audit.select(F.col(key).cast("string").alias("document_id"), F.lit(0).alias("d"),
                                            F.lit(1).alias("a"))))
        bucket = F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        folder = staging_path(self.spark, "integrity")
        new = stage(tagged.groupBy("document_id").agg(
            F.sum("d").alias("documents"), F.sum("a").alias("audit_entries")).select("*", bucket), "integrity", folder)
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}
        old = self._read(self._folders(touched))
        merged = new.drop("bucket").unionByName(old).groupBy("document_id").agg(
            F.sum("documents").alias("documents"), F.sum("audit_entries").alias("audit_entries")).select("*", bucket)
        data = f"{self.path}/state/{uuid.uuid4().hex}"
        merged.repartition("bucket").write.partitionBy("bucket").parquet(data)
        remove_path(self.spark, folder)
        written = [(b, f"{data}/bucket={b}") for b in sorted(touched)]
        self._commit(run_id, (known[0] or 0) + 1, written)
        return self._read([f for _, f in written]).where("documents <> 1 or audit_entries <> 1")
