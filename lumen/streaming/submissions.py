"""K3: contact-form submissions appended to a CSV log, as a stream.

Submissions arrive as JSON files (email, subject, message) in a folder; a
Structured Streaming query appends them to a CSV sink with minimal quoting
and no header. The checkpoint makes the append exactly-once across restarts
and lost executors; ``availableNow`` drains what is there and stops, so the
same code runs as a scheduled batch or continuously.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

SUBMISSION_SCHEMA = "email string, subject string, message string"


def append_submissions(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                       available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    stream = (spark.readStream.schema(SUBMISSION_SCHEMA).json(source_dir)
              .select("email", "subject", "message"))
    writer = (stream.writeStream.format("csv").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint)
              .option("header", False).option("escape", '"')
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_log(spark: SparkSession, sink_dir: str):
    """The appended log read back (multi-line messages, doubled quotes)."""
    return (spark.read.schema(SUBMISSION_SCHEMA).option("header", False).option("multiLine", True)
            .option("escape", '"').csv(sink_dir))
