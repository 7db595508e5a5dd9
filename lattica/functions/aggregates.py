"""The aggregating functions. Each gets the name of the column of its argument, and the argument's type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .typed import MISSING, Typed, is_node, is_number, is_rel, is_whole, null

AGGREGATES: dict[str, Callable[..., Typed]] = {}


def aggregate(*names: str) -> Callable:
    def register(build: Callable[..., Typed]) -> Callable[..., Typed]:
        AGGREGATES.update(dict.fromkeys(names, build))
        return build

    return register


def _sql(name: str, column: str, distinct: bool) -> Column:
    return F.expr(f"{name}({'DISTINCT ' * distinct}`{column}`)")


@aggregate("count")
def count(x: Typed, column: str, distinct: bool, p: Typed | None = None) -> Typed:
    if is_node(x) or is_rel(x):
        key = F.col(f"`{column}`").getField("_id")
        return Typed(F.count_distinct(key) if distinct else F.count(key), T.LongType())
    return Typed(_sql("count", column, distinct), T.LongType())


@aggregate("sum")
def total(x: Typed, column: str, distinct: bool, p: Typed | None = None) -> Typed:
    """Of no numbers 0, never null."""
    if not is_number(x):
        return Typed(F.coalesce(F.max(F.lit(0)), F.lit(0)).cast("long"), T.LongType())
    kind = T.LongType() if is_whole(x) else T.DoubleType()
    return Typed(F.coalesce(_sql("sum", column, distinct).cast(kind), F.lit(0).cast(kind)), kind)


@aggregate("avg")
def mean(x: Typed, column: str, distinct: bool, p: Typed | None = None) -> Typed:
    return Typed(_sql("avg", column, distinct).cast("double"), T.DoubleType()) if is_number(x) else null(T.DoubleType())


@aggregate("min")
def least(x: Typed, column: str, distinct: bool, p: Typed | None = None) -> Typed:
    return Typed(_sql("min", column, False), x.type)


@aggregate("max")
def greatest(x: Typed, column: str, distinct: bool, p: Typed | None = None) -> Typed:
    return Typed(_sql("max", column, False), x.type)


@aggregate("collect")
def collect(x: Typed, column: str, distinct: bool, p: Typed | None = None) -> Typed:
    return Typed(_sql("collect_set" if distinct else "collect_list", column, False), T.ArrayType(x.type))


@aggregate("stdev")
def stdev(x: Typed, column: str, distinct: bool, p: Typed | None = None) -> Typed:
    return Typed(_sql("stddev_samp", column, distinct), T.DoubleType()) if is_number(x) else null(T.DoubleType())


@aggregate("stdevp")
def stdevp(x: Typed, column: str, distinct: bool, p: Typed | None = None) -> Typed:
    return Typed(_sql("stddev_pop", column, distinct), T.DoubleType()) if is_number(x) else null(T.DoubleType())


def share_of(p: Typed | None) -> float | None:
    ok = p is not None and p.value is not MISSING and isinstance(p.value, (int, float)) and 0 <= p.value <= 1
    return float(p.value) if ok else None


@aggregate("percentilecont")
def percentile_cont(x: Typed, column: str, distinct: bool, p: Typed | None = None) -> Typed:
    """Interpolated between neighbours."""
    share = share_of(p)
    if share is None or not is_number(x):
        return null(T.DoubleType())
    return Typed(F.expr(f"percentile({'DISTINCT ' * distinct}`{column}`, {share!r}D)"), T.DoubleType())


@aggregate("percentiledisc")
def percentile_disc(x: Typed, column: str, distinct: bool, p: Typed | None = None) -> Typed:
    """The value at place floor(p (n - 1)) of the sorted values. As a column it only says that there are such values;
    ``placed`` finds them."""
    if share_of(p) is None or not is_number(x):
        return null(T.DoubleType())
    return Typed(F.first(F.lit(None).cast(x.type)), x.type)


def placed(rows: DataFrame, by: list[str], column: str, distinct: bool, share: float, name: str) -> DataFrame:
    """(by, name): percentileDisc of a column for each group. Equal values are counted first, and a running sum over the
    different ones finds the place, so that no group's values are held at once."""
    keys = [F.col(f"`{c}`") for c in by]
    counted = rows.filter(F.col(f"`{column}`").isNotNull()).groupBy(*keys, F.col(f"`{column}`")).agg((F.lit(1) if distinct else F.count("*")).cast("long").alias("__n"))
    group = Window.partitionBy(*keys) if by else Window.partitionBy(F.lit(1))
    upto = group.orderBy(F.col(f"`{column}`")).rowsBetween(Window.unboundedPreceding, 0)
    totals = counted.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    met = counted.withColumn("__upto", F.sum("__n").over(upto))
    test = F.lit(True)
    for c in by:
        test = test & F.col(f"`{c}`").eqNullSafe(F.col(f"`{c}~`"))
    met = met.join(totals.select(*[F.col(f"`{c}`").alias(f"{c}~") for c in by], "__all"), test)
    place = F.floor(F.lit(share) * (F.col("__all") - 1))
    return met.filter((F.col("__upto") > place) & (F.col("__upto") - F.col("__n") <= place)).select(*[F.col(f"`{c}`").alias(f"{c}~") for c in by], F.col(f"`{column}`").alias(name))
