"""Continuous ingestion of a directory with Structured Streaming."""

from __future__ import annotations

import logging
import threading
import zlib
from collections.abc import Callable
from pathlib import Path
from typing import Any
from urllib.parse import quote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docsieve.functions.files import watched_glob
from docsieve.plans.batch import run_batch
from docsieve.rules import RuleStore
from docsieve.schemas import BINARY_FILE
from docsieve.session import checkpoint_folder
from docsieve.sources.documents import _described

log = logging.getLogger(__name__)

BatchHandler = Callable[[DataFrame, int], None]


def arrivals(spark: SparkSession, directory: str, *, recursive: bool = False,
             max_files: int | None = None, max_age: str = "3650000d") -> DataFrame:
    """New document files as a stream. Other extensions are dropped at listing, in any case.

    ``max_age`` bounds how much older than the newest file a file may be and still count as new;
    the default of ten thousand years is no bound, so no file is left out for its age.
    """
    reader = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("pathGlobFilter", watched_glob())
        .option("recursiveFileLookup", str(recursive).lower())
        .option("maxFileAge", max_age))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _described(reader.load(directory))


class DirectoryStream:
    """Hands every batch of new files to a handler; ``start`` and ``stop`` may be repeated.

    With ``keep_going`` the handler is called again on parts of a batch it failed on, down to single files,
    so that only files which fail on their own are left out. These are logged and written with their error to
    the ``failed`` table beside the checkpoint. Such a handler must bear to see a file again. Without
    ``keep_going`` the query fails and a restart replays the batch.
    """

    def __init__(self, spark: SparkSession, watch_dir: str, handler: BatchHandler, *,
                 recursive: bool = False, checkpoint: str | None = None, keep_going: bool = True,
                 trigger: dict[str, Any] | None = None, max_files: int | None = None) -> None:
        self.spark, self.watch_dir, self.handler = spark, watch_dir, handler
        self.recursive, self.keep_going, self.max_files = recursive, keep_going, max_files
        self.trigger = trigger or {"processingTime": "1 second"}
        self.checkpoint = checkpoint or f"{checkpoint_folder(spark)}/arrivals-{zlib.crc32(watch_dir.encode()):08x}"
        self.failed = f"{self.checkpoint}-failed"
        self.query: StreamingQuery | None = None
        self.started = threading.Event()
        if urlparse(watch_dir).scheme in ("", "file"):
            Path(urlparse(watch_dir).path).mkdir(parents=True, exist_ok=True)

    @property
    def is_running(self) -> bool:
        return self.query is not None and self.query.isActive

    def _handle(self, batch: DataFrame, batch_id: int) -> None:
        try:
            self.handler(batch, batch_id)
        except Exception:
            if not self.keep_going:
                raise
            log.exception("handler failed for batch %d, trying parts of it", batch_id)
            paths = [r.source_path for r in batch.select("source_path").distinct().sort("source_path").collect()]
            lost = self._isolate(batch, batch_id, paths)
            if lost:
                self.spark.createDataFrame(lost, "source_path string, error string").coalesce(1).write.mode(
                    "overwrite").json(f"{self.failed}/batch_id={batch_id}")

    def _isolate(self, batch: DataFrame, batch_id: int, paths: list[str]) -> list[tuple[str, str]]:
        """Files of a failed part (sorted paths, known to the driver as the batch's listing) that fail alone."""
        if len(paths) < 2:
            parts = [paths] if paths else []
        else:
            parts = [paths[:len(paths) // 2], paths[len(paths) // 2:]]
        lost: list[tuple[str, str]] = []
        for part in parts:
            try:
                self.handler(batch.where(F.col("source_path").between(part[0], part[-1])), batch_id)
            except Exception as exc:
                if len(part) > 1:
                    lost += self._isolate(batch, batch_id, part)
                else:
                    log.exception("handler failed for %s", part[0])
                    lost.append((part[0], f"{type(exc).__name__}: {exc}"))
        return lost

    def start(self) -> StreamingQuery:
        if self.is_running:
            log.warning("already watching %s", self.watch_dir)
            return self.query
        stream = arrivals(self.spark, self.watch_dir, recursive=self.recursive, max_files=self.max_files)
        self.started.clear()
        self.query = (
            stream.writeStream.foreachBatch(self._handle)
            .option("checkpointLocation", self.checkpoint).trigger(**self.trigger).start())
        self.started.set()
        return self.query

    def stop(self, timeout: int = 5) -> None:
        if self.query is None:
            return
        self.query.stop()
        self.query.awaitTermination(timeout)
        self.query = None


def ingest(spark: SparkSession, watch_dir: str, *, results_path: str, audit_path: str, stream_id: str,
           rules: RuleStore | None = None, recursive: bool = False, checkpoint: str | None = None,
           trigger: dict[str, Any] | None = None, max_files: int | None = None,
           **options: Any) -> DirectoryStream:
    """Process arriving files into the result and audit tables, each file exactly once.

    Dictionaries are re-read per micro-batch, so an edit takes effect without a restart. A batch
    writes into its own folder, named after the stream, the checkpoint and the batch number; a replay
    overwrites exactly that folder. A stream whose checkpoint was lost reads every file again into new
    folders and leaves the earlier audit as it is. Streams of different ids over one directory each see
    every file. The checkpoint lies in the audit table's folder unless given.
    """
    store = rules or RuleStore()
    stream: DirectoryStream

    def handle(batch: DataFrame, batch_id: int) -> None:
        stream.started.wait()
        # The id of the query lives in its checkpoint: kept over restarts, new with a new checkpoint.
        origin = str(stream.query.id).replace("-", "")
        run = run_batch(batch, store.load(), results_path=results_path, audit_path=audit_path,
                        run_id=f"{stream_id}-{origin}-{batch_id:09d}", mode="overwrite", **options)
        run.discard_staging()

    name = quote(stream_id, safe="")
    checkpoint = checkpoint or f"{audit_path.rstrip('/')}/_streams/{name}-{zlib.crc32(watch_dir.encode()):08x}"
    stream = DirectoryStream(
        spark, watch_dir, handle, recursive=recursive, checkpoint=checkpoint, keep_going=False,
        trigger=trigger, max_files=max_files)
    stream.start()
    return stream
