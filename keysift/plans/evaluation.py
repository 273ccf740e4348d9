"""The evaluation run: a stored detector over a test set, with its report."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.operators.evaluate import Evaluation, evaluate
from keysift.plans.detector import Detector
from keysift.plans.reports import evaluation_report, write_report
from keysift.sources.files import read_split, read_testset

logger = logging.getLogger(__name__)


def test_rows(
    spark: SparkSession, test_file: str | None = None, split_path: str | None = None
) -> DataFrame | None:
    """Rows ``(text, label)`` of the test file, else of the test part of a stored split."""
    rows = read_testset(spark, test_file) if test_file else None
    if rows is None and split_path:
        split = read_split(spark, split_path)
        rows = None if split is None else split.where(F.col("split") == "test")
    if rows is None:
        logger.error("no test data")
        return None
    return rows.select("text", "label")


test_rows.__test__ = False


def evaluate_detector(
    detector: Detector, rows: DataFrame | None, output: str | None = None
) -> Evaluation | None:
    """Detect over ``(text, label)`` and compare; predictions follow rules and threshold.

    With ``output`` the result tables are written as JSON and the report as text.
    """
    if rows is None:
        return None
    result = evaluate(detector.detect(rows))
    if output:
        base = output.rstrip("/")
        for name in ("confusion", "report", "pr_curve", "roc_curve", "summary"):
            getattr(result, name).write.mode("overwrite").json(f"{base}/{name}")
        lines = evaluation_report(result.summary, result.report, result.confusion)
        write_report(rows.sparkSession, lines, f"{base}/evaluation_report")
    return result
