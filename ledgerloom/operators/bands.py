"""Partners of rows: equal keys and nearby dates.

Spark has no band join: the band would be a residual filter over all pairs of a key, and pairs
would be shuffled to meet again by row. Here rows go through one exchange, by keys and a
stretch of days; a row near a border visits the next stretch as well. A window over the days
lists each row's partners, so a key with many rows costs its neighbouring days, not its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A stretch is so many windows long.
STRETCH = 8


def stretches(rows: DataFrame, day: str, window: int, stretch: int = STRETCH, later_only: bool = False) -> DataFrame:
    """Rows with __d (the day's number), __at (a stretch of days) and __home: whether __at is
    the row's own. A stretch holds every row at most `window` days from its own rows, before
    or after; later_only: after."""
    if window < 0:
        raise ValueError("a window is not negative")
    width = max(1, stretch * window)
    at = lambda c: F.floor(c / width).cast("bigint")
    d = F.col("__d")
    r = rows.withColumn("__d", F.unix_date(F.col(day)))
    r = r.withColumn("__at", F.explode(F.array_distinct(F.array(at(d - window), at(d), *([] if later_only else [at(d + window)])))))
    return r.withColumn("__home", F.col("__at") == at(d))


def with_near(rows: DataFrame, keys: list[str], day: str, window: int | None, id_: str = "entry_id", carry: list[str] = ()) -> DataFrame:
    """Adds `near`: an array of (day, id, carried columns) of the rows of another id with equal
    keys and dates at most `window` days apart; None: any dates. A null key, or day where days
    count, has no partners."""
    lone = [F.col(c).isNull() for c in (keys if window is None else [*keys, day])]
    alone = lone[0]
    for c in lone[1:]:
        alone = alone | c
    r = rows.withColumn("__alone", F.when(alone, F.col(id_)))
    w = W.partitionBy(*keys, "__alone")
    if window is not None:
        first = F.coalesce(F.col(day), F.lit("1970-01-01").cast("date"))
        r = stretches(r.withColumn("__day", first), "__day", window).drop("__day")
        w = W.partitionBy(*keys, "__at", "__alone").orderBy("__d").rangeBetween(-window, window)
    r = r.withColumn("near", F.collect_list(F.struct(*dict.fromkeys([day, id_, *carry]))).over(w))
    if window is not None:
        r = r.where("__home").drop("__d", "__at", "__home")
    return r.drop("__alone").withColumn("near", F.filter("near", lambda x: x[id_] != F.col(id_)))


def partner_ids(near: Column, id_: str = "entry_id") -> Column:
    return F.array_sort(F.array_distinct(F.transform(near, lambda x: x[id_])))


def first_partner(near: Column, by: list[str], more: dict[str, Callable[[Column], Column]]) -> Column:
    """A struct of the partner that comes first by the columns, with values made of it."""
    return F.array_min(F.transform(near, lambda x: F.struct(*[x[c].alias(c) for c in by], *[f(x).alias(k) for k, f in more.items()])))
