"""Evidence that a board was read completely: passes, attempts and verified windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of attempts that give complete structured records. Fixed values.
TRUSTED = ["greenhouse", "successfactors", "smartrecruiters"]


def pass_audit(rows: DataFrame, board: str = "company_id", order: str = "run", key: str = "external_id") -> DataFrame:
    """Each pass of a board: rows, unique_ids, duplicate_rows, duplicate_ids, new_ids, prior_ids_missing and whether the board ``mutated`` between its passes.

    New are ids that no earlier pass has, missing those of earlier passes that it
    lacks. Rows without an id count as rows, and as duplicates of nothing.
    """
    counted = rows.where(F.col(key).isNotNull()).groupBy(board, order, key).agg(F.count("*").alias("_n"))
    first = counted.groupBy(board, key).agg(F.min(order).alias(order))
    new = first.groupBy(board, order).agg(F.count("*").alias("new_ids"))
    passes = rows.groupBy(board, order).agg(F.count("*").alias("rows"))
    ids = counted.groupBy(board, order).agg(F.count("*").alias("unique_ids"), F.sum(F.col("_n") - 1).alias("duplicate_rows"), F.count_if(F.col("_n") > 1).alias("duplicate_ids"))
    held = passes.join(ids, [board, order], "left").join(new, [board, order], "left").na.fill(0, ["unique_ids", "duplicate_rows", "duplicate_ids", "new_ids"])
    so_far = Window.partitionBy(board).orderBy(order)
    held = held.withColumns({"prior_ids_missing": F.sum("new_ids").over(so_far.rowsBetween(Window.unboundedPreceding, 0)) - F.col("unique_ids"), "_first": F.row_number().over(so_far) == 1})
    moved = ~F.col("_first") & ((F.col("new_ids") > 0) | (F.col("prior_ids_missing") > 0))
    return held.withColumn("mutated", F.max(moved).over(Window.partitionBy(board))).drop("_first")


def best_of(attempts: DataFrame, board: str = "company_id") -> DataFrame:
    """The attempt that counts for each board: the first trusted one with rows ends the search, else the one with most usable rows, then the best share, then most rows; the earliest of equals.

    attempts: board, attempt, kind, usable, rows. Boards whose attempts all gave nothing are left out.
    """
    trusted = F.coalesce(F.col("kind").isin(*TRUSTED), F.lit(False))
    rank = F.struct((~trusted).alias("t"), F.when(~trusted, -F.col("usable")).alias("u"), F.when(~trusted, -F.col("usable") / F.col("rows")).alias("s"), F.when(~trusted, -F.col("rows")).alias("r"), F.col("attempt").alias("a"))
    filled = attempts.where("rows > 0").withColumn("trusted", trusted)
    return filled.groupBy(board).agg(F.min_by(F.struct("attempt", "kind", "usable", "rows", "trusted"), rank).alias("x")).select(board, "x.*")


def window_certificate(marks: DataFrame, board: list[str], exhausted: Column | None = None) -> DataFrame:
    """What each window proves: (board, stable, missing, extra, missing_witness, target, described, verdict).

    marks: a row an id with before, produced, after, witness, in_target and has_text. Ids that stand both before and after must
    be produced, so must those that a witness saw and that are still there, and each produced row in the target needs its text;
    ``exhausted``, where given, must hold for every row of the window.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    stable, made = yes("before") & yes("after"), yes("produced")
    whole = F.lit(True) if exhausted is None else F.bool_and(F.coalesce(exhausted, F.lit(False)))
    found = marks.groupBy(*board).agg(
        F.count_if(stable).alias("stable"),
        F.count_if(stable & ~made).alias("missing"),
        F.count_if(made & ~stable).alias("extra"),
        F.count_if(yes("witness") & yes("after") & ~made).alias("missing_witness"),
        F.count_if(made & yes("in_target")).alias("target"),
        F.count_if(made & yes("in_target") & yes("has_text")).alias("described"),
        whole.alias("_whole"),
    )
    passed = (F.col("missing") == 0) & (F.col("missing_witness") == 0) & (F.col("target") == F.col("described")) & F.col("_whole")
    return found.withColumn("verdict", F.when(passed, "CERTIFIED").otherwise("FAILED")).drop("_whole")
