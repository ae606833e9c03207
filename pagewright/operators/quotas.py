"""Coverage of a selection against its targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Targets of a selection of a hundred pages.
TYPES = {"book": 50, "periodical": 25, "legal": 20, "misc": 5}
DIFFICULTIES = {"clean": 35, "medium": 40, "hard": 25}
SIGNALS = {"yellowed": 30, "low_contrast": 20, "skewed": 20, "table_heavy": 15, "multi_column": 15, "handwriting": 10, "old_fonts": 15}


def coverage(rows: DataFrame, column: str, kept: str, targets: dict[str, int]) -> DataFrame:
    """(column, n, target, met) for each target, also those that no kept row counts for; targets are a small fixed table."""
    cells = F.array(*[F.struct(F.lit(k).alias(column), F.lit(n).alias("target")) for k, n in targets.items()])
    wanted = rows.sparkSession.range(1).select(F.inline(cells))
    found = rows.where(F.col(kept) & F.col(column).isin(*targets)).groupBy(column).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return wanted.join(found, column, "left").select(column, n.alias("n"), "target", (n >= F.col("target")).alias("met"))
