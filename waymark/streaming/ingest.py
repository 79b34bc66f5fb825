"""Streams: documents into an index, queries against one, and what happens on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from waymark.config import Options
from waymark.operators import index as ix
from waymark.operators.index import Index
from waymark.plans import geocode
from waymark.sources import readers
from waymark.sources.readers import FEATURE


def read_documents(spark: SparkSession, folder: str, files_per_batch: int = 10) -> DataFrame:
    """Feature documents (NDJSON in the stored columns) as they arrive."""
    return spark.readStream.schema(FEATURE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def index_stream(docs: DataFrame, sources: DataFrame, out: str, checkpoint: str, on_error: str = "fail") -> StreamingQuery:
    """Each micro-batch of documents becomes an index of its own (``batch_id``), by the term frequencies of the batch: writing it
    again after a failure overwrites itself. ``merged`` reads the batches as one index."""

    def write(batch: DataFrame, batch_id: int) -> None:
        made = ix.build(batch, sources, on_error)
        readers.put_features(batch.sparkSession, f"{out}/features", made.features, batch_id)
        made.grid.write.mode("overwrite").parquet(f"{out}/grid/version={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, out: str, sources: DataFrame) -> Index:
    """The index of all batches so far; of equal (source, id) the latest batch's document and postings hold. Nothing is indexed again."""
    features = readers.stored_features(spark, f"{out}/features")
    grid = spark.read.parquet(f"{out}/grid")
    latest = spark.read.option("mergeSchema", "true").parquet(f"{out}/features").groupBy("source", "id").agg(F.max("version").alias("version"))
    held = grid.join(latest, ["source", "id", "version"]).drop("version")
    return Index(sources, features, held.select("source", "phrase").distinct(), held)


def geocode_stream(queries: DataFrame, index: Index, out: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Answers each micro-batch of queries (query_id, query) against the index."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        geocode.geocode(batch, index, options).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Lifecycle(StreamingQueryListener):
    """Calls back at a stream's start ("open"), after each of its micro-batches ("index", with its number of rows), and at its end ("store",
    with the error that ended it, or null). Register it with ``spark.streams.addListener``."""

    def __init__(self, **handlers: Callable):
        self.handlers = handlers

    def _call(self, event: str, *args) -> None:
        if event in self.handlers:
            self.handlers[event](*args)

    def onQueryStarted(self, event) -> None:
        self._call("open", str(event.id))

    def onQueryProgress(self, event) -> None:
        self._call("index", str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._call("store", str(event.id), event.exception)
