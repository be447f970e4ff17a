"""Splitting off rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.operators.lineage import Run


def quarantined(df: DataFrame, condition: str, model: str, run: Run = Run()) -> DataFrame:
    """Rows for which ``condition`` is true (not NULL), with where and when they were caught."""
    return df.where(F.expr(condition)).withColumns(
        {
            "_quarantine_source": F.lit(model),
            "_quarantine_git_commit": F.lit(run.git_commit),
            "_quarantine_detected_at": F.lit(run.deployed_at),
        }
    )


def split(
    df: DataFrame, condition: str, model: str, run: Run = Run(), keep_bad: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined). The quarantine is a copy by default: the model keeps every row. With
    ``keep_bad=False`` bad rows leave the model; a rule that comes out NULL keeps its row there."""
    clean = df if keep_bad else df.where(~F.coalesce(F.expr(condition), F.lit(False)))
    return clean, quarantined(df, condition, model, run)
