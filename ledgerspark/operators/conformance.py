"""Conformance: expected against actual outcomes of test variations, rolled up by suite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(variations: DataFrame, actual: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """variations with actual codes and outcome.

    variations: suite_id, test_case_id, variation_id, expected_type (valid, warning or error), expected_code, mandatory.
    actual: suite_id, variation_id, code, exception_message; none for a variation that ran without findings;
    a row with a null code and a message for one that broke. Skipped ones have the code 'skipped'.
    """
    kept = actual.where(F.col("code").isNull() | ~F.col("code").isin(*ignored)) if ignored else actual
    codes = kept.groupBy("suite_id", "variation_id").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.max("exception_message").alias("broke"))
    met = variations.join(codes, ["suite_id", "variation_id"], "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    local = F.regexp_replace("expected_code", "^.*[:}]", "")
    hit = F.exists("codes", lambda c: (c == F.col("expected_code")) | F.endswith(c, local)) | F.coalesce(F.contains("broke", local), F.lit(False))
    as_expected = F.when(F.col("expected_type") == "error", F.when(F.col("expected_code").isNull(), (F.size("codes") > 0) | F.col("broke").isNotNull()).otherwise(hit)).otherwise(F.size("codes") == 0)
    outcome = F.when(F.array_contains("codes", "skipped"), "skipped").when(F.col("broke").isNotNull() & ~as_expected, "error").when(as_expected, "pass").otherwise("fail")
    return met.withColumn("outcome", outcome)


def rollup(results: DataFrame) -> DataFrame:
    """A row a suite: counts, status (errors before failures before passes) and exit code; only mandatory ones decide."""
    counted = results.groupBy("suite_id").agg(
        *(F.count_if(F.col("outcome") == o).alias(o) for o in ("pass", "fail", "error", "skipped")),
        F.count_if(F.col("mandatory") & (F.col("outcome") == "error")).alias("bad_errors"), F.count_if(F.col("mandatory") & (F.col("outcome") == "fail")).alias("bad_fails"),
    )
    status = F.when(F.col("bad_errors") > 0, "ERRORED").when(F.col("bad_fails") > 0, "FAILED").when(F.col("pass") > 0, "PASSED").otherwise("SKIPPED")
    return counted.withColumn("status", status).withColumn("exit_code", F.col("status").isin("ERRORED", "FAILED").cast("int")).drop("bad_errors", "bad_fails")
