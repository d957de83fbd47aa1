"""Taking in aligned CSV files as they arrive; each run reads what is new and ends."""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import ingest


def ingest_available(spark: SparkSession, folder: str, out: str, checkpoint: str, mode: str = "relational") -> None:
    """Append the kept rows (en and fr as text_en and text_fr, with their file) of files not yet read to a Parquet folder, then stop.

    Ids aren't given here, as they count over all rows; number the written rows when pairs are made."""
    rows = spark.readStream.schema("en string, fr string").option("header", True).option("escape", '"').option("multiLine", True).csv(folder)
    kept = ingest.clean_rows(rows.withColumn("file", F.col("_metadata.file_path")), mode)
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
