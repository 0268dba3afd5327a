"""Decisions and audit events as streams: a tail of a table, an idempotent upsert, and a watermarked wait for settlements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..sinks import store


def tail(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """New rows of a folder of Parquet files; the checkpoint of the query is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_decisions(decisions: DataFrame, path: str, batch_id: str, checkpoint: str, whole_every: int = 50) -> StreamingQuery:
    """Write each micro-batch of decisions over the stored ones; run again, it changes nothing and keeps review states.

    A micro-batch writes its own rows only; after every ``whole_every`` of them the batch is written as a whole once.
    """

    def write(rows: DataFrame, number: int) -> None:
        store.upsert_records(rows, path, batch_id)
        if number % whole_every == whole_every - 1:
            store.compact(rows.sparkSession, path, batch_id)

    return decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 day") -> DataFrame:
    """Events per window and type under a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def write_changes(aggregated: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the groups that each micro-batch changed, with the batch's number: windows that are still open are there too.

    A batch that is run again after a failure replaces its own folder.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return aggregated.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_groups(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """The latest row of each group that ``write_changes`` left; the watermark's state forgets closed windows, the table keeps them."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


def await_settlements(ledger: DataFrame, settlements: DataFrame, days: int = 21) -> DataFrame:
    """Ledger rows with their settlement by reference, or without one once ``days`` have passed, as a stream-stream join."""
    left = ledger.withColumn("ref_norm", text.normalize_reference(F.col("reference_id"))).withWatermark("order_date", "1 day").alias("l")
    right = settlements.withColumn("s_ref", text.normalize_reference(F.col("order_reference"))).withColumnRenamed("order_date", "s_order_date").withWatermark("settlement_date", "1 day").alias("s")
    near = (F.col("settlement_date") >= F.col("order_date")) & (F.col("settlement_date") <= F.col("order_date") + F.expr(f"INTERVAL {days} DAYS"))
    return left.join(right, (F.col("ref_norm") == F.col("s_ref")) & near, "leftOuter").select("l.order_id", "l.reference_id", "l.amount_minor", "l.order_date", "s.payment_id", "s.gross_amount_minor", "s.settlement_date")
