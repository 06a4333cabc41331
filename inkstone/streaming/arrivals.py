"""Documents as they arrive: each micro-batch goes through the batch pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstone.functions.providers import EmbeddingProvider
from inkstone.plans.ingest import ingest
from inkstone.sources.documents import BINARY, PageProvider, PlainText, flattened, pages
from inkstone.sources.store import Store


def watch(
    spark: SparkSession, folder: str, store: Store, checkpoint: str, suffix: str = ".pdf", provider: PageProvider | None = None,
    embedding: EmbeddingProvider | None = None, max_files: int = 100,
) -> StreamingQuery:
    """Ingest the files of a folder as they arrive. A batch that is run again after a failure adds nothing twice, because
    its ids are in the store by then."""
    arrived = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", max_files).load(folder)

    def one(batch: DataFrame, _: int) -> None:
        docs = batch.where(F.lower("path").endswith(suffix)).select(F.md5("content").alias("doc_hash"), "content").dropDuplicates(["doc_hash"])
        ingest(flattened(pages(docs, provider or PlainText())), store, embedding)

    return arrived.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_time(arrivals: DataFrame, at: str = "arrived_at", late: str = "30 days", every: str = "1 day", key: str = "batch_no") -> DataFrame:
    """(window, key, n) of a stream of records; records later than `late` are dropped, as are those without a time."""
    rows = arrivals.where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, every), key).agg(F.count("*").alias("n"))
