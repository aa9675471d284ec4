"""Windowed counts and incremental ingest as Structured Streaming queries. An extension: the batch operators define the semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.text import squeezed
from quillon.operators.analytics import latest_by
from quillon.operators.indexing import content_hash


def windowed_questions(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, normalized_question, ask_count, unresolved) of a stream or a table; later events than `late` are dropped in a stream."""
    key = F.lower(squeezed("question")).alias("normalized_question")
    held = events.withWatermark("created_at", late) if events.isStreaming else events
    out = held.groupBy(F.window("created_at", window), key).agg(F.count("*").alias("ask_count"), F.bool_or(F.col("review_required") | F.col("abstained")).alias("unresolved"))
    return out.select(F.col("window.start").alias("window_start"), "normalized_question", "ask_count", "unresolved")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n) of runs of a user's events without a longer gap."""
    held = events.withWatermark("created_at", gap) if events.isStreaming else events
    out = held.groupBy("user_id", F.session_window("created_at", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def start(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished windows to Parquet, all data at hand, then stops."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


KEY = ("repository_url", "source_path")


def ingested(spark: SparkSession, path: str, before: int | None = None, key: tuple[str, ...] = KEY) -> DataFrame | None:
    """The rows that an ingest into `path` holds now, or held before a batch: the latest of each key. None before the first batch."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [] if not fs.exists(where) else [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("batch=")]
    paths = [p.toString() for p in done if (before is None or int(p.getName()[6:]) < before) and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not paths:
        return None
    rows = spark.read.option("basePath", path).parquet(*paths)
    return latest_by(rows, list(key), F.desc("batch")).drop("batch")


def ingest_batch(rows: DataFrame, batch: int, path: str, key: tuple[str, ...] = KEY, order: str = "updated_at", body: str = "text") -> None:
    """Writes the rows of a batch whose content is new, as the folder of that batch: doing a batch again replaces what it wrote.

    Of several rows of a key in a batch the latest by `order` counts, nulls first, then the largest hash. A row whose content equals that of the
    key's row before it is left out, so what is written grows with changes alone.
    """
    spark = rows.sparkSession
    once = latest_by(rows.withColumn("content_hash", content_hash(body)), list(key), F.desc_nulls_last(order), F.desc("content_hash"))
    held = ingested(spark, path, batch, key)
    new = once if held is None else once.join(held.select(*key, "content_hash"), [*key, "content_hash"], "left_anti").select(once.columns)
    new.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def ingest(stream: DataFrame, path: str, checkpoint: str, key: tuple[str, ...] = KEY, order: str = "updated_at", body: str = "text") -> StreamingQuery:
    """Ingests all files at hand from a stream of them, then stops; a restart goes on with the batch that wasn't finished."""
    step = lambda rows, batch: ingest_batch(rows, batch, path, key, order, body)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
