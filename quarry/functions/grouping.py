"""Skew-aware building blocks shared by the operators.

* ``first_by``: the first row per key as an aggregate (``min_by`` of a struct),
  which combines map-side, so a hot key never lands whole in one task.
* ``row_number_by``: 1-based numbering within a key ordered by an integral
  column, computed per (key, order bucket) plus an offset, so a hot key is
  spread over many tasks instead of one window partition.
* ``number_within``: the same for an order of any columns, in two levels:
  rows are range-partitioned and sorted by (key, order), counted per (key,
  partition), and shifted by the counts of earlier partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: str | Column,
             cols: Sequence[str] | None = None, descending: bool = False,
             tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row per ``keys``: the row with the least (or greatest) ``order``.

    The order (with ``tiebreak`` columns appended) should be unique within a
    key: then the pick is deterministic and a recomputed partition after an
    executor loss yields the same row.
    """
    cols = [c for c in (cols or df.columns) if c not in keys]
    o = F.col(order) if isinstance(order, str) else order
    if tiebreak:
        o = F.struct(o, *[F.col(c) for c in tiebreak])
    pick = F.max_by if descending else F.min_by
    agg = df.groupBy(*keys).agg(pick(F.struct(*[F.col(c) for c in cols]), o).alias("__r"))
    return agg.select(*keys, *[F.col("__r")[c].alias(c) for c in cols])


def row_number_by(df: DataFrame, keys: Sequence[str], order: str, out: str = "rn",
                  tiebreak: Sequence[str] = (), width: int = 4096) -> DataFrame:
    """``row_number() over (partition by keys order by order, *tiebreak)``.

    ``order`` must be integral. Rows are numbered inside (key, order // width)
    buckets and shifted by the count of rows in earlier buckets of the key.
    """
    bucket = F.floor(F.col(order) / F.lit(width)).cast("decimal(38,0)")  # ``order`` may be a wide decimal
    b = df.withColumn("__b", bucket)
    counts = b.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w_prev = (Window.partitionBy(*keys).orderBy("__b")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w_prev), F.lit(0))).drop("__n")
    w = Window.partitionBy(*keys, "__b").orderBy(F.col(order), *[F.col(c) for c in tiebreak])
    return (b.join(offsets, [*keys, "__b"])
             .withColumn(out, (F.row_number().over(w) + F.col("__off")).cast("long"))
             .drop("__b", "__off"))


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn",
                  store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` in two levels.

    No task holds more than one range partition, however many rows a key
    has; the only window is over one row per (key, partition). Nulls are
    values, first in order. Rows equal in keys and order stay in one
    partition, so ``order`` should tell rows apart. ``store`` keeps the
    partitioned rows (default ``materialize``): ranges are sampled, so their
    places must be fixed once.
    """
    cols = [F.col(c) for c in (*keys, *order)]
    dealt = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    placed = (store or materialize)(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)  # the partition is in the id's upper bits
    runs = placed.groupBy(*keys, part.alias("__in")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    shifts = runs.select(*named, "__in", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    same = part == F.col("__in")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return (placed.join(shifts, same).withColumn(out, F.col("__at") + F.col("__shift"))
            .select(*df.columns, out))


def materialize(df: DataFrame, small: bool = False) -> DataFrame:
    """Compute ``df`` once for several consumers.

    With a checkpoint folder (``spark.checkpoint.dir``, a shared folder on a
    cluster) the rows are written there and lineage is cut, so a lost
    executor does not force a recompute from the raw input; otherwise they
    are persisted (memory, spilling to disk). ``small=True`` is for little
    derived tables whose lineage already starts at a checkpoint: they are
    only persisted (lazily, no extra job); a lost block is recomputed cheaply.
    """
    if small:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if conf_dir:
            sc.setCheckpointDir(conf_dir)
    if sc.getCheckpointDir():
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)
