"""Crawled rows that keep arriving: each micro-batch's new fields are added to a folder of raw fields, from which the index is built.

An extension, as the original only builds in batches. A field that was loaded before is passed over, so a batch that is
run again after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators.index import first_loads


def ingest_fields(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start adding the stream's rows (as in ``object_fields``) to ``folder`` until no more are there."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = first_loads(batch)
        try:
            known = spark.read.parquet(folder).select("object_id", "field_id")
        except Exception as e:  # nothing there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            new = new.join(known, ["object_id", "field_id"], "left_anti")
        new.write.mode("append").parquet(folder)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
