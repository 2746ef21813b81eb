"""Source files measured as they arrive: a file stream, scanned in batches, that resumes from its checkpoint.

What has been measured is the stream's own state, so a pass that is stopped goes on with the files not yet done, and a
batch is written once: its number names its folder, and a repeated batch overwrites that.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sieveline.java import facts

FILES = "path string, modificationTime timestamp, length long, content binary"


def measured(spark: SparkSession, root: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Scans the Java files under `root` that weren't scanned before, and writes their units to `out`, a folder a batch."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").option("maxFilesPerTrigger", files_per_batch).load(root)

    def write(batch: DataFrame, number: int) -> None:
        facts.units(batch.select(batch["path"].alias("file"), "content")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def events_by_minute(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Findings per type and window of event time; what comes later than the watermark doesn't count."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def landed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream appends from all that is there now, as a table in the folder that the cluster shares; it resumes from its checkpoint if a task is lost."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: there is no folder that the executors share")
        base = f"file://{tempfile.mkdtemp(prefix='stream')}"
    out = f"{base}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
