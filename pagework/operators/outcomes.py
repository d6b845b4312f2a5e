"""One row per request: it went through, or why it did not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def results(checked: DataFrame, *keep: str) -> DataFrame:
    """``request_id, success, error`` and the columns to ``keep`` of requests that carry ``errors``; a projection."""
    failed = F.size("errors") > 0
    return checked.select(
        "request_id", *keep, (~failed).alias("success"), F.when(failed, F.array_join("errors", "; ")).alias("error")
    )


def results_of(requests: DataFrame, errors: DataFrame) -> DataFrame:
    """The same for an operator's ``Outcome``, whose ``errors`` hold only the failed requests."""
    found = requests.select("request_id").join(errors.select("request_id", "errors"), "request_id", "left")
    return results(found.withColumn("errors", F.coalesce("errors", F.array().cast("array<string>"))))


def write_results(checked: DataFrame, path: str, *keep: str) -> dict[str, int]:
    """Writes ``results`` of requests that carry ``errors`` as Parquet, and counts ``requests``, ``succeeded`` and ``failed`` in the
    same pass, so that the table is worked out once."""
    seen = Observation()
    told = results(checked, *keep).observe(
        seen,
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("success")).alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
    )
    told.write.mode("overwrite").parquet(path)
    return seen.get


RESULT = "success BOOLEAN, error STRING"


def to_result_json(outcomes: DataFrame) -> DataFrame:
    """``request_id, result``: each outcome as the JSON text a caller gets."""
    text = F.to_json(F.struct("success", "error"), {"ignoreNullFields": "false"})
    return outcomes.select("request_id", text.alias("result"))


def from_result_json(lines: DataFrame) -> DataFrame:
    """Outcomes from ``request_id, result``; a text that is no JSON object counts as failed."""
    parsed = lines.select("request_id", F.from_json("result", RESULT).alias("_r"))
    success = F.coalesce("_r.success", F.lit(False))
    return parsed.select(
        "request_id",
        success.alias("success"),
        F.when(~success, F.coalesce("_r.error", F.lit("Unknown error"))).alias("error"),
    )
