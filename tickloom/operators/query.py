"""Optional-argument filters, ordering and paging."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_where(df: DataFrame, *, equals: dict | None = None, start: dict | None = None,
                 end: dict | None = None, prefix: dict | None = None,
                 isin: dict[str, Iterable] | None = None, where: list[Column] | None = None,
                 order: list | None = None) -> DataFrame:
    """Conjunction of the arguments that are given; None values add no condition."""
    conds = [F.col(c) == v for c, v in (equals or {}).items() if v is not None]
    conds += [F.col(c) >= F.lit(v) for c, v in (start or {}).items() if v is not None]
    conds += [F.col(c) <= F.lit(v) for c, v in (end or {}).items() if v is not None]
    conds += [F.col(c).startswith(v) for c, v in (prefix or {}).items() if v is not None]
    conds += [F.col(c).isin(list(v)) for c, v in (isin or {}).items() if v is not None]
    conds += list(where or [])
    if conds:
        df = df.filter(reduce(lambda a, b: a & b, conds))
    return df.orderBy(*order) if order else df


def page(df: DataFrame, order: list, page_no: int = 1, page_size: int = 100) -> DataFrame:
    """One page in a total order (``order`` must end in a unique key)."""
    return df.orderBy(*order).offset((page_no - 1) * page_size).limit(page_size)


def page_after(df: DataFrame, order: dict[str, bool], last: tuple | None = None, page_size: int = 100) -> DataFrame:
    """The page that follows the key ``last`` (the first page if None).

    ``order`` maps the columns of a total order without nulls to whether they ascend. Pages cost the
    same however deep they lie: rows up to the key are filtered out, by the first column already in
    the scan, and no task keeps more than a page.
    """
    sort = [F.col(c).asc() if up else F.col(c).desc() for c, up in order.items()]
    if last is not None:
        types = dict(df.dtypes)
        keys = [(F.col(c), F.lit(v).cast(types[c]), up) for (c, up), v in zip(order.items(), last, strict=True)]
        column, value, up = keys[0]
        df = df.filter(column >= value if up else column <= value)
        beyond = F.lit(False)
        for column, value, up in reversed(keys):
            further = column > value if up else column < value
            beyond = further | ((column == value) & beyond)
        df = df.filter(beyond)
    return df.orderBy(*sort).limit(page_size)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Whole latest row per key: one aggregation with map-side combine, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")
