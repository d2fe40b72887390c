"""Run a finite stream to its end and read the result back as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridhazard.session import scratch_path


def drain(stream: DataFrame, name: str, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Process all available input; state and result live in ``folder`` (a fresh one in the shared folder by default).

    A query that is started again with the same folder continues from its checkpoint. ``complete``: each micro-batch
    replaces the result. ``append``: each batch is a folder of its own, named by its id, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, name)
    out = f"{folder}/result"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    q = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)
