"""Row-by-row growth of an index: a stream of rows is posted batch by batch under fixed options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from raregram.operators.index import GramIndex
from raregram.operators.statistics import gram_frequencies
from raregram.options import GramOptions


class GramIngest:
    """Appends micro-batches to the postings under ``path``. A repeated batch overwrites its own folder."""

    def __init__(self, path: str, row_id: str, text: str, options: GramOptions):
        self.path, self.row_id, self.text, self.options = path, row_id, text, options

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        built = GramIndex.build(batch, self.row_id, self.text, self.options)
        p = built.postings.repartitionByRange("gram", "row_id").sortWithinPartitions("gram", "row_id")
        p.write.mode("overwrite").parquet(f"{self.path}/postings/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        spark = stream.sparkSession
        o = self.options
        spark.createDataFrame([(o.min_q, o.max_q, list(o.frequent))], "min_q int, max_q int, frequent array<string>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_frequencies(stream: DataFrame, text: str, min_q: int, max_q: int) -> DataFrame:
    """Running (gram, df) of a stream of texts, for the complete or update output mode."""
    return gram_frequencies(stream, text, min_q, max_q)
