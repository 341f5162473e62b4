"""Training events: last event, best so far, early stopping, running totals, summaries and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paralex.operators.replay import numbered
from paralex.operators.tables import written


def latest(events: DataFrame, run: str, order: str) -> DataFrame:
    """Each run's last event; a partial aggregation, not a sort."""
    fields = [c for c in events.columns if c not in (run, order)]
    best = F.max_by(F.struct(*fields), order).alias("e")
    return events.groupBy(run).agg(F.max(order).alias(order), best).select(run, order, "e.*")


def _parts(events: DataFrame, run: str, order: str) -> DataFrame:
    """events with __p, the range of (run, order) that a row lies in: a long run is cut over many."""
    return written(events.repartitionByRange(run, order).withColumn("__p", F.spark_partition_id()), "runs")


def _carried(rows: DataFrame, parts: DataFrame, run: str) -> DataFrame:
    """rows with what parts (__p, run, others) hold for their part."""
    named = parts.withColumnsRenamed({"__p": "__at", run: "__run"})
    return rows.join(named, (rows["__p"] == named["__at"]) & rows[run].eqNullSafe(named["__run"])).drop("__at", "__run")


def best_so_far(events: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """events with best (least value up to the row), improved and streak (rows since the last improvement).

    Rows before a run's first value count as improved.  A scan of two levels: a part of a run is summed up by its rows,
    its least value and where that stands first; from the parts before, a part gets the least value so far and the last
    row that improved, and its own rows go on from there.  So a run of any length is spread over all tasks."""
    inside = W.partitionBy("__p", run).orderBy(order)
    rows = _parts(events, run, order).withColumn("__n", F.row_number().over(inside))
    rows = rows.withColumn("__before", F.min(value).over(inside.rowsBetween(W.unboundedPreceding, -1)))
    first = F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("__n").alias("n"))))
    parts = rows.groupBy("__p", run).agg(F.count("*").alias("__size"), first.alias("__least"))
    earlier = W.partitionBy(run).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({"__prior": F.min("__least.v").over(earlier), "__rows": F.coalesce(F.sum("__size").over(earlier), F.lit(0))})
    last = F.when(F.col("__prior").isNull(), F.coalesce("__least.n", "__size")).when(F.col("__least.v") < F.col("__prior"), F.col("__least.n"))
    parts = parts.withColumn("__last", F.col("__rows") + last).withColumn("__last", F.max("__last").over(earlier))
    rows = _carried(rows, parts.drop("__size", "__least"), run)
    before = F.least("__prior", "__before")  # of one null and a value, the value
    rows = rows.withColumns({"improved": before.isNull() | (F.col(value) < before), "best": F.least(before, value), "__n": F.col("__rows") + F.col("__n")})
    here = F.max(F.when(F.col("improved"), F.col("__n"))).over(inside.rowsBetween(W.unboundedPreceding, 0))
    out = rows.withColumn("streak", F.col("__n") - F.greatest("__last", here))
    return out.select(*events.columns, "improved", "best", "streak")


def early_stop(events: DataFrame, run: str, order: str, value: str, patience: int) -> DataFrame:
    """(run, stop): where each run's streak first reaches the patience; null where it never does."""
    return best_so_far(events, run, order, value).groupBy(run).agg(F.min(F.when(F.col("streak") >= patience, F.col(order))).alias("stop"))


def running_totals(events: DataFrame, run: str, order: str, *values: str) -> DataFrame:
    """events with running_<value>: sums within parts of a run, each on top of the parts before."""
    rows = _parts(events, run, order)
    parts = rows.groupBy("__p", run).agg(*(F.sum(v).alias(f"__{v}") for v in values))
    earlier = W.partitionBy(run).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({f"__{v}": F.sum(f"__{v}").over(earlier) for v in values})
    inside = W.partitionBy("__p", run).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = _carried(rows.withColumns({f"running_{v}": F.sum(v).over(inside) for v in values}), parts, run)
    # null until a run's first value
    sums = {f"running_{v}": F.coalesce(F.col(f"running_{v}") + F.col(f"__{v}"), f"running_{v}", f"__{v}") for v in values}
    return rows.withColumns(sums).select(*events.columns, *sums)


def retained(rows: DataFrame, keep: int, *order: Column, by: str | None = None) -> DataFrame:
    """rows with `deleted`: all but the newest `keep` (of each group)."""
    if by is None:
        return numbered(rows, *order).withColumn("deleted", F.col("position") >= keep).drop("position")
    return rows.withColumn("deleted", F.row_number().over(W.partitionBy(by).orderBy(*order)) > keep)


def every(step: Column, n: int) -> Column:
    return step % n == 0


def of_type(events: DataFrame, *types: str, column: str = "event") -> DataFrame:
    return events.where(F.col(column).isin(*types))


def overview(manifests: DataFrame, results: DataFrame, events: DataFrame, run: str, order: str) -> DataFrame:
    """Each run of manifests with its result, its last event (fields prefixed by last_) and its status: the result's, or
    training where there is none yet.  results has status; a run occurs once in manifests and in results."""
    last = latest(events, run, order)
    last = last.withColumnsRenamed({c: f"last_{c}" for c in last.columns if c != run})
    out = manifests.join(results, run, "left").join(last, run, "left")
    return out.withColumn("status", F.coalesce("status", F.lit("training")))


def overview_counts(runs: DataFrame) -> DataFrame:
    """How many runs there are, and how many are training, failed, or have a result."""
    flag = lambda x: F.count_if(F.col("status") == x)
    return runs.agg(F.count("*").alias("runs"), flag("training").alias("active"), flag("failed").alias("failed"), F.count_if(F.col("status") != "training").alias("finished"))
