"""Run-log analytics: machine use and training times from text logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_cpu_log(lines: DataFrame) -> DataFrame:
    """(name, rate, ts) of lines of a process monitor followed by milliseconds; lines of 10 characters or fewer go."""
    t = F.split(F.trim("value"), r"\s+")
    kept = lines.filter(F.length(F.trim("value")) > 10).select(t.alias("t")).filter(F.size("t") >= 10)
    return kept.select(F.get("t", F.lit(0)).alias("name"), F.expr("try_cast(t[8] AS double)").alias("rate"), F.expr("try_cast(element_at(t, -1) AS bigint)").alias("ts"))


def parse_gpu_log(lines: DataFrame) -> DataFrame:
    """(rate, ts): the fourth field from the end, `n%`, and the last."""
    kept = lines.select(F.split(F.trim("value"), r"\s+").alias("t")).filter(F.size("t") >= 4)
    return kept.select(F.element_at("t", -4).alias("rate"), F.expr("try_cast(element_at(t, -1) AS bigint)").alias("ts"))


def cpu_usage(usage: DataFrame, start: int, end: int, slack: int = 500) -> DataFrame:
    """Mean rate by name, strictly inside (start - slack, end + slack)."""
    inside = usage.filter((F.col("ts") > start - slack) & (F.col("ts") < end + slack))
    return inside.groupBy("name").agg(F.avg("rate").alias("rate"), F.count("*").alias("rows"))


def gpu_usage(usage: DataFrame, start: int, end: int, slack: int = 500) -> DataFrame:
    """Mean of `n%` in [start - slack, end + slack]."""
    inside = usage.filter(F.col("ts").between(start - slack, end + slack))
    return inside.agg(F.avg(F.regexp_replace("rate", "%", "").cast("double")).alias("rate"), F.count("*").alias("rows"))


def parse_train_log(lines: DataFrame) -> DataFrame:
    """(epoch, seconds, loss, accuracy, correct, total), by epoch number."""
    number = r"([-+0-9.eE]+)"
    line = F.col("value")
    found = lines.select(
        F.expr("try_cast(nullif(regexp_extract(value, '[Ee]poch[\\\\s\\\\[:]*(\\\\d+)', 1), '') AS int)").alias("epoch"),
        F.regexp_extract(line, rf"[Tt]ime\D*?{number}", 1).alias("seconds"), F.regexp_extract(line, rf"[Ll]oss\D*?{number}", 1).alias("loss"),
        F.regexp_extract(line, rf"Train Acc:\s*{number}\s+(\d+)\s+(\d+)", 1).alias("acc"), F.regexp_extract(line, rf"Train Acc:\s*{number}\s+(\d+)\s+(\d+)", 2).alias("correct"), F.regexp_extract(line, rf"Train Acc:\s*{number}\s+(\d+)\s+(\d+)", 3).alias("total"),
    )
    as_ = lambda c, t: F.expr(f"try_cast(nullif({c}, '') AS {t})")
    return found.filter("epoch is not null").groupBy("epoch").agg(
        F.max(as_("seconds", "double")).alias("seconds"), F.max(as_("loss", "double")).alias("loss"), F.max(as_("acc", "double")).alias("accuracy"),
        F.max(as_("correct", "bigint")).alias("correct"), F.max(as_("total", "bigint")).alias("total"),
    )


def parse_metrics(lines: DataFrame, run: str = "run") -> DataFrame:
    """(run, name, value) of lines `#name=value (s)` and `name: value (s)`."""
    pattern = r"^#?\s*([A-Za-z_][\w /%.-]*?)\s*[=:]\s*([-+]?[0-9.]+(?:[eE][-+]?\d+)?)\s*(?:\(?s\)?)?\s*$"
    key = F.lit("run") if run not in lines.columns else F.col(run)
    found = lines.select(key.alias("run"), F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).alias("v"))
    return found.filter("name <> ''").select("run", "name", F.expr("try_cast(v AS double)").alias("value"))


def read_runs(spark: SparkSession, path: str, file: str = "output.log") -> DataFrame:
    """(run, value): the lines of the log of every run folder below path; the run is named by its folder, or by what
    follows `=` in the folder's name."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file).text(path)
    return lines.select(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "(?:[^/=]*=)?([^/]+)/[^/]+$", 1)).alias("run"), "value")


def reordered(run: Column) -> Column:
    """A run's name with the last of its parts (by _) put before the two that precede it; shorter names stay."""
    parts = F.split(run, "_")
    moved = F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 3, F.lit(0))), F.slice(parts, -1, 1), F.slice(parts, -3, 2))
    return F.when(F.size(parts) >= 3, F.array_join(moved, "_")).otherwise(run)


def epoch_time_table(metrics: DataFrame, name: str = "average epoch time") -> DataFrame:
    """(run, seconds): one row for each run, by its reordered name, picked by the name of the metric."""
    return metrics.filter(F.lower(F.col("name")) == name).groupBy(reordered(F.col("run")).alias("run")).agg(F.max("value").alias("seconds"))
