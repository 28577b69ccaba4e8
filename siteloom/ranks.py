"""Ranks, running sums and last values inside groups of any size: no task gathers a group's rows.

Rows are put in order over range partitions and written; what each part holds of a group is summed, and prefix
sums over the parts (a row each) say where a part begins. The rest is local to a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.tables import cut

#: Numbers that ascend with a table's order: the part in bits 33 and up, the row in it below.
ORDER, PART, PART_BITS = "_siteloom_order", "_siteloom_part", 33
GROUP, TIE, SALT = "_siteloom_group", "_siteloom_tie", "_siteloom_salt"
#: Salts of a two-step top-k.
SALTS = 64


def in_order(df: DataFrame, name: str, *keys: Column | str) -> DataFrame:
    """df written in ascending order of keys over range partitions, with ORDER.

    The place of a row in what it was read from breaks ties, so that equal rows spread over parts as well.
    """
    dealt = df.withColumn(TIE, F.monotonically_increasing_id()).repartitionByRange(*keys, TIE).sortWithinPartitions(*keys, TIE)
    return cut(dealt.drop(TIE).withColumn(ORDER, F.monotonically_increasing_id()), name)


def _grouped(df: DataFrame, name: str, group: list[str], order: list[Column | str]) -> DataFrame:
    """in_order with a row's PART, and its group as one struct, which is never null and so joins by equality."""
    rows = in_order(df, name, *group, *order)
    return rows.withColumns({PART: F.shiftright(ORDER, PART_BITS), GROUP: F.struct(*group) if group else F.struct(F.lit(0).alias("all"))})


def _earlier(column: str) -> Column:
    """The sum over a group's earlier parts."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(GROUP).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(df: DataFrame, name: str, group: list[str], order: list[Column | str], number: str = "number", total: str | None = None) -> DataFrame:
    """df with a row's place in its group by `order`, from 1; `total` names a column for the group's number of rows."""
    rows = _grouped(df, name, group, order)
    cells = rows.groupBy(PART, GROUP).agg(F.min(ORDER).alias("_siteloom_first"), F.count("*").alias("_siteloom_n"))
    everywhere = [F.sum("_siteloom_n").over(Window.partitionBy(GROUP)).alias(total)] if total else []
    bases = cells.select(PART, GROUP, "_siteloom_first", _earlier("_siteloom_n").alias("_siteloom_base"), *everywhere)
    place = F.col(ORDER) - F.col("_siteloom_first") + F.col("_siteloom_base") + 1
    return rows.join(bases, [PART, GROUP]).select(*df.columns, place.alias(number), *([total] if total else []))


def running(df: DataFrame, name: str, group: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """df with each of `sums` over the rows of its group that come earlier by `order`; zero for the first."""
    rows = _grouped(df.withColumns({f"_siteloom_{k}": v for k, v in sums.items()}), name, group, order)
    cells = rows.groupBy(PART, GROUP).agg(*(F.sum(f"_siteloom_{k}").alias(f"_siteloom_{k}") for k in sums))
    bases = cells.select(PART, GROUP, *(_earlier(f"_siteloom_{k}").alias(f"_siteloom_base_{k}") for k in sums))
    local = Window.partitionBy(PART, GROUP).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"_siteloom_{k}": F.coalesce(F.sum(f"_siteloom_{k}").over(local), F.lit(0)) for k in sums})
    return own.join(bases, [PART, GROUP]).select(*df.columns, *((F.col(f"_siteloom_{k}") + F.col(f"_siteloom_base_{k}")).alias(k) for k in sums))


def carried(df: DataFrame, name: str, group: list[str], order: list[Column | str], values: dict[str, Column]) -> DataFrame:
    """df with, for each of `values`, the last one that isn't null among the rows of its group that come earlier by `order`."""
    rows = _grouped(df.withColumns({f"_siteloom_{k}": v for k, v in values.items()}), name, group, order)
    cells = rows.groupBy(PART, GROUP).agg(*(F.max_by(f"_siteloom_{k}", F.when(F.col(f"_siteloom_{k}").isNotNull(), F.col(ORDER))).alias(f"_siteloom_{k}") for k in values))
    parts = Window.partitionBy(GROUP).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select(PART, GROUP, *(F.last(f"_siteloom_{k}", ignorenulls=True).over(parts).alias(f"_siteloom_base_{k}") for k in values))
    local = Window.partitionBy(PART, GROUP).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"_siteloom_{k}": F.last(f"_siteloom_{k}", ignorenulls=True).over(local) for k in values})
    return own.join(bases, [PART, GROUP]).select(*df.columns, *(F.coalesce(f"_siteloom_{k}", f"_siteloom_base_{k}").alias(k) for k in values))


def top(df: DataFrame, group: list[str], order: list[Column], limit: int, spread: list[str], rank: str = "rank") -> DataFrame:
    """Each group's first `limit` rows by a total order, with their rank: first inside salts, then among what is left.

    spread: columns that tell a group's rows apart. A task of the second step reads `limit` rows a salt at most.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    first = df.withColumn(SALT, salt).withColumn(rank, F.row_number().over(Window.partitionBy(*group, SALT).orderBy(*order))).where(F.col(rank) <= limit)
    return first.drop(SALT, rank).withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= limit)
