"""An import run that can be watched: index, total, outcomes and errors while the stream goes on, and a report of every file.

Files come in micro-batches. What a batch holds is observed on the stream and told by a listener; what became of it is observed on the report that the batch writes. So nothing is counted twice or collected.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from ..session import cut_lineage, shared_folder
from ..sources import photos
from .ingest import FILES

REPORT = "name string, sha256 string, outcome string, message string, batch long"
OUTCOMES = {"imported": "imported", "duplicates": "duplicate", "errors": "error"}


class _Listener(StreamingQueryListener):
    """Tells a job what its own query does."""

    def __init__(self, job: IngestJob):
        self.job = job

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802 - named by Spark
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.job.metric)
        if seen is not None and seen["files"]:
            self.job._update(index=self.job._state["index"] + seen["files"], current=seen["last"])

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        if self.job.query is not None and str(event.runId) == str(self.job.query.runId):
            self.job._update(running=False, current=None, error=event.exception)


class IngestJob:
    """Imports the images of a folder that no earlier run has seen; one run at a time.

    `state` is a folder for the stream's checkpoint and the reports (by default in the shared folder). A batch that is run again after a failure writes its report anew, so each file
    has one line. An unreadable file isn't recorded, so a copy of it is an error too.
    """

    def __init__(self, spark: SparkSession, folder: str, state: str | None = None, files_per_batch: int = 100):
        self.spark, self.folder, self.files_per_batch = spark, folder, files_per_batch
        self.state = (state or f"{shared_folder(spark)}/ingest").rstrip("/")
        self.metric = f"ingest_{id(self)}"
        self.query: StreamingQuery | None = None
        self._lock = threading.Lock()
        self._state: dict[str, object] = {"running": False, "current": None, "index": 0, "total": 0, "error": None, **dict.fromkeys(OUTCOMES, 0)}
        self._listener = _Listener(self)
        spark.streams.addListener(self._listener)

    def _update(self, **values: object) -> None:
        with self._lock:
            self._state.update(values)

    def status(self) -> dict[str, object]:
        """running, current (last file begun), index (files done), total, imported, duplicates, errors, error (of a run that broke off)."""
        with self._lock:
            return dict(self._state)

    def results(self) -> DataFrame:
        """name, sha256, outcome, message, batch of every file so far, of all runs."""
        return self.spark.read.schema(REPORT).option("recursiveFileLookup", "true").parquet(f"{self.state}/reports") if self._has_reports() else self.spark.createDataFrame([], REPORT)

    def _has_reports(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/reports")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _batch(self, files: DataFrame, batch: int) -> None:
        known = self.results().where((F.col("outcome") == "imported") & (F.col("batch") < batch)).select("sha256", "name")
        seen = Observation()
        # Contents are read once, and so the stream's own observation counts each file once.
        own = cut_lineage(photos.examined(files))
        report = photos.reported(own, known).withColumn("batch", F.lit(batch).cast("long"))
        report = report.observe(seen, *(F.count_if(F.col("outcome") == kind).alias(name) for name, kind in OUTCOMES.items()))
        report.write.mode("overwrite").parquet(f"{self.state}/reports/{batch}")
        counts = seen.get
        with self._lock:
            for name in OUTCOMES:
                self._state[name] = int(self._state[name]) + int(counts[name] or 0)

    def start(self) -> bool:
        """Begin a run over what is in the folder now; False if one is going on."""
        with self._lock:
            if self._state["running"]:
                return False
            self._state.update(running=True, current=None, index=0, total=0, error=None, **dict.fromkeys(OUTCOMES, 0))
        try:
            done = self.results().select("name")
            names = photos.named(self.spark.read.format("binaryFile").load(self.folder).select("path")).select("name")
            self._update(total=names.join(done, "name", "left_anti").count())
            files = self.spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", self.files_per_batch).load(self.folder)
            files = photos.named(files).observe(self.metric, F.count("*").alias("files"), F.max("name").alias("last"))
            writer = files.writeStream.option("checkpointLocation", f"{self.state}/checkpoint").trigger(availableNow=True)
            self.query = writer.foreachBatch(self._batch).start()
        except Exception as problem:
            self._update(running=False, error=str(problem))
            raise
        return True

    def wait(self, seconds: float | None = None) -> bool:
        """Wait for the run to end; True if it has. What broke it off is in status()."""
        if self.query is None:
            return True
        try:
            return bool(self.query.awaitTermination(seconds)) if seconds is not None else self.query.awaitTermination() is None
        except Exception as problem:  # the run's own error, which status() shows
            self._update(running=False, error=str(problem))
            return True

    def close(self) -> None:
        self.spark.streams.removeListener(self._listener)
