"""What a job tells while it runs: JSON lines in a folder, replayed from the start and then followed.

A line has event (progress, done or error), at (its number in the job), step, rows and message. A job that ended tells
nothing more.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "event string, at long, step string, rows long, message string"


class JobLog:
    """The lines of one job; each call adds one file, whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.at, self.ended = spark, path, 0, False

    def tell(self, lines: list[dict]) -> None:
        if self.ended or not lines:
            return
        texts = []
        for line in lines:
            texts.append(json.dumps({"event": "progress", "at": self.at, "step": "", "rows": 0, "message": "", **line}, ensure_ascii=False))
            self.at += 1
            self.ended = self.ended or line.get("event") in ("done", "error")
        self.spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(self.path)


def _parsed(lines: DataFrame) -> DataFrame:
    """The lines that are JSON objects with an event; others, which libraries may print, are left out."""
    return lines.select(F.from_json("value", LINE).alias("l")).where("l.event IS NOT NULL").select("l.*")


def history(spark: SparkSession, path: str) -> DataFrame:
    """All that a job has told so far."""
    return _parsed(spark.read.text(path))


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A stream of what a job has told and, as it comes, of what it tells."""
    return _parsed(spark.readStream.text(path))


def logged(stream: DataFrame, log_path: str, folder: str, step: str | None = None) -> DataFrame:
    """Run a stream over all input there is into `folder`, telling each batch's rows by step, and how it ended; what it wrote."""
    spark = stream.sparkSession
    log = JobLog(spark, log_path)
    total = 0

    def batch(rows: DataFrame, n: int) -> None:
        nonlocal total
        rows.write.mode("append").parquet(f"{folder}/out")
        counted = rows.groupBy((F.col(step) if step else F.lit("")).cast("string").alias("step")).count().collect()
        log.tell([{"step": r["step"], "rows": r["count"], "message": f"batch {n}"} for r in sorted(counted, key=lambda r: r["step"] or "")])
        total += sum(r["count"] for r in counted)

    try:
        stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    except Exception as e:
        log.tell([{"event": "error", "message": str(e).split("\n")[0][:500]}])
        raise
    log.tell([{"event": "done", "rows": total}])
    return spark.read.parquet(f"{folder}/out")
