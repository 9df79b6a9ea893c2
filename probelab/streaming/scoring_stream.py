"""The scoring job as an incremental stream.

Each micro-batch of texts goes through the job's own resumable write
(``scoring.run_missing``) in ``foreachBatch``: rows and questions that the
feature store holds, from a batch run, an earlier file or the same micro-batch
before a failure, are left out, so a stream and batch runs may fill one store
and no key comes twice. ``trigger(availableNow=True)`` processes what has
arrived and stops; the checkpoint records which input files are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from probelab.operators import scoring as S


def texts_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet files of ``(dataset, row_id, text)`` as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def score_stream(spark: SparkSession, texts: DataFrame, cat: DataFrame, out_path: str,
                 checkpoint: str, scorer=None, budget: int = S.TOKEN_BUDGET):
    """Start the availableNow scoring query; returns the StreamingQuery."""
    def write(batch: DataFrame, _: int) -> None:
        S.run_missing(batch, cat, out_path, scorer, budget=budget)

    return (texts.select("dataset", "row_id", "text").writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
