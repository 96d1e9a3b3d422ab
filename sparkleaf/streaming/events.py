"""The file-event pipeline on Structured Streaming: parse, filter, route, deduplicate, retry, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files

EVENT = "event string, data struct<id:string, object:string, bytes:bigint, created_at:bigint, filename:string, purpose:string, space_code:string, cuid:bigint, cu_name:string, pages:int>, metadata string, reconsume_times int"
METADATA = "post_processors array<string>, user string, callbacks array<string>"
MAX_TRIES = 3


def kafka_source(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Raw messages (value) of a topic from its start; needs Spark's Kafka connector on the class path."""
    df = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return df.select(F.col("value").cast("string").alias("value"))


def kafka_sink(messages: DataFrame, servers: str, topic: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Send messages (value, and key if there is one) to a topic, acknowledged by all replicas and tried nine times more.

    A stream needs a checkpoint folder and gives its query. Needs Spark's Kafka connector on the class path.
    """
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "9", "kafka.retry.backoff.ms": "1000"}
    sent = messages.select(*[F.col(c).cast("string").alias(c) for c in ("key", "value") if c in messages.columns])
    if messages.isStreaming:
        return sent.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
    sent.write.format("kafka").options(**options).save()
    return None


def folder_source(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Raw messages (value), one a line, of the files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def accepted(messages: DataFrame) -> DataFrame:
    """Events for new assistant files of a supported type whose metadata is a JSON object: (id, name, bytes, pages, ..., route).

    Messages that aren't JSON, other events or purposes, and metadata that isn't an object are passed over. Works on
    batch and stream alike.
    """
    e = F.from_json("value", EVENT)
    meta = F.from_json(F.col("e.metadata"), METADATA)
    rows = messages.select(e.alias("e")).where((F.col("e.event") == "file.created") & (F.col("e.data.purpose") == "assistants"))
    rows = rows.where(F.trim(F.col("e.metadata")).startswith("{")).withColumn("m", meta).where(F.col("m").isNotNull() & files.is_supported(F.col("e.data.filename")))
    size, pages = F.coalesce("e.data.bytes", F.lit(0)), F.coalesce("e.data.pages", F.lit(0))
    return rows.select(F.col("e.data.id").alias("id"), F.col("e.data.filename").alias("name"), size.alias("bytes"), pages.alias("pages"), F.timestamp_seconds(F.col("e.data.created_at")).alias("created_at"), F.coalesce("m.post_processors", F.array().cast("array<string>")).alias("post_processors"), F.coalesce("m.callbacks", F.array().cast("array<string>")).alias("callbacks"), "m.user", F.coalesce("e.reconsume_times", F.lit(0)).alias("tries"), files.route(F.col("e.data.filename"), size, pages).alias("route"))


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each file id once within the delay that the watermark keeps."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])


def retries(failed: DataFrame) -> DataFrame:
    """Failed rows with tries raised and where they go next: retry, or dead from the third failure on."""
    more = failed.withColumn("tries", F.col("tries") + 1)
    return more.withColumn("next", F.when(F.col("tries") >= MAX_TRIES, "dead").otherwise("retry"))


def parse_status(results: DataFrame) -> DataFrame:
    """All columns and status: failed if both layout and tree are empty, else finished."""
    return results.withColumn("status", F.when(F.col("layout").isNull() & F.col("dom").isNull(), "failed").otherwise("finished"))


def run_routes(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write events to a folder for each route. A batch that is run again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("route").parquet(f"{path}/batch={number}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
