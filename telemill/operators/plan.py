"""Shaping of plans."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate_once(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fix the columns' values at this point of the plan.

    A filter on a computed column is otherwise pushed below the projection, which then parses the
    message a second time to decide the filter. Filters do not move below a generator.
    """
    kept = [c for c in frame.columns if c not in columns]
    return frame.select(*kept, F.inline(F.array(F.struct(*columns))))


def copies(counted: DataFrame, count: str, per_step: int = 100_000) -> DataFrame:
    """Every row as often as its ``count`` says, with the number of the ``copy`` from 0.

    A large count is cut into steps that many tasks write out, so no row grows beyond ``per_step``.
    """
    kept = [F.col(f"`{c}`") for c in counted.columns if c != count]
    n = F.col(count)
    steps = counted.where(n > 0).withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(per_step).cast("bigint"))))
    last = F.least(F.col("_step") + per_step, n) - 1
    return steps.hint("rebalance").select(*kept, F.explode(F.sequence(F.col("_step"), last)).alias("copy"))
