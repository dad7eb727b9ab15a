"""The text log of past runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
# Tags that make a line an error or a warning, and the texts that mark progress.
ERROR_TAGS = ["[error]"]
WARNING_TAGS = ["[warning]", "[anomaly]", "[geocode]"]
DECODED = r"decoded (\d+)/(\d+) logfile\(s\) so far"
STEPS = [
    r"Building trips from \d+ GPS position\(s\)",
    r"\d+ navigation samples merged, classifying trips",
    r"\d+ run\(s\) classified, computing per-trip statistics",
    r"\d+ trip\(s\) found, writing logbook",
]


def _has(line: Column, tags: list[str]) -> Column:
    found = F.lit(False)
    for t in tags:
        found = found | line.contains(t)
    return found


def parse_lines(lines: DataFrame) -> DataFrame:
    """``value`` to logged time (NULL when unparsable), severity, progress phase, step and total."""
    line = F.col("value")
    at = F.when(line.rlike(STAMP), F.try_to_timestamp(F.substring(line, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))
    phase = F.when(line.rlike(DECODED), "decoding")
    step = F.when(line.rlike(DECODED), F.regexp_extract(line, DECODED, 1).try_cast("int"))
    total = F.when(line.rlike(DECODED), F.regexp_extract(line, DECODED, 2).try_cast("int"))
    for i, pattern in enumerate(STEPS):
        phase = phase.when(line.rlike(pattern), "building_trips")
        step = step.when(line.rlike(pattern), i + 1)
        total = total.when(line.rlike(pattern), len(STEPS))
    severity = F.when(_has(line, ERROR_TAGS), "error").when(_has(line, WARNING_TAGS), "warning").otherwise("info")
    return lines.withColumns({"logged_at": at, "severity": severity, "phase": phase, "step": step, "total": total})


def prune(parsed: DataFrame, now: Column, keep_days: float) -> DataFrame:
    """Without lines older than ``keep_days``; lines without a readable time stay."""
    oldest = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(keep_days * 86400.0).cast("decimal(18,6)"))
    return parsed.where(F.col("logged_at").isNull() | (F.col("logged_at") >= oldest))


def read_run_log(spark, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))
