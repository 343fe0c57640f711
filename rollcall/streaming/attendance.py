"""The attendance load as a file stream: files that landed decide which days are rebuilt.

The stream only finds days. Each micro-batch takes the days of its new files and loads
those days whole, with the batch load's own steps: read the day folders, enrich, replace
the days, mark them. So batch and stream write one table in one way, a late or corrected
page of an old day appears, and a batch that runs twice after a crash gives the same
table. ``trigger(availableNow=True)`` processes what has landed since the last run and
stops; the checkpoint remembers the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rollcall import schemas
from rollcall.plans.attendance import load_days
from rollcall.sources import DAY_COL

# Files are found by name, however old they are: the default forgets them after a week.
_ANY_AGE = "36500d"
# What Spark's file listing source gives for a file.
_FILE = "path string, modificationTime timestamp, length long, content binary"


def landed_days(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming frame with one row per new file: the day of its folder. No file is opened: of
    the files' columns only the folder's day is read, never the content."""
    reader = (spark.readStream.format("binaryFile").schema(f"{_FILE}, {DAY_COL} date").option("maxFileAge", _ANY_AGE))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(f"{landing}/attendance").select(DAY_COL)


def run_attendance_stream(spark: SparkSession, landing: str, warehouse: str, checkpoint: str,
                          devices: DataFrame | None = None, multi_line: bool = True,
                          record=schemas.ATTENDANCE, device_record=schemas.DEVICES, dedupe_dim: bool = False,
                          max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Rebuild every day that has new files, until caught up. ``devices`` (default: the
    landed ones, read anew for each batch) must be a batch frame."""
    def rebuild(batch: DataFrame, _: int) -> None:
        days = [r[0] for r in batch.select(DAY_COL).distinct().collect()]      # one row a day
        load_days(batch.sparkSession, landing, warehouse, [d for d in days if d is not None], devices=devices,
                  multi_line=multi_line, record=record, device_record=device_record, dedupe_dim=dedupe_dim)

    q = (landed_days(spark, landing, max_files_per_trigger).writeStream.foreachBatch(rebuild)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
