"""Facts of files as they arrive (an extension: the batch operators are the reference point)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.php.facts import fact_rows
from ..sources.projects import MAX_BYTES, wanted

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_facts(spark: SparkSession, folder: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Parse each new source file once and append its fact rows to out, exactly once, partitioned by table."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.php").load(folder)
    files = files.where(F.col("length") <= MAX_BYTES).select(F.regexp_replace("path", "^file:(//)?", "").alias("file_path"), F.decode("content", "UTF-8").alias("content")).where(wanted(F.col("file_path")))
    return fact_rows(files).writeStream.format("parquet").partitionBy("table").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
