"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.plans.bindings import Frames, StagedFrames
from tickloom.plans.oracle_ctes import with_ctes
from tickloom.plans.output_types import typed


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    plan: Callable[[Frames], DataFrame]
    oracle: str | None
    frames: type[Frames] = Frames

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.plan(self.frames(spark, sf_dir))
        money = [f.name for f in out.schema.fields if isinstance(f.dataType, T.DecimalType)]
        return out.withColumns({c: F.col(c).cast("double") for c in money}) if money else out

    __call__ = run


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None, staged: bool = False):
    """Register a plan. ``oracle`` is SQL over the driver tables and the shared CTEs; ``staged``
    writes the reduced quotes once, for plans that look at them many times."""

    def add(fn: Callable[[Frames], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, covers, fn, typed(name, with_ctes(oracle)) if oracle else None,
                              StagedFrames if staged else Frames)
        return fn

    return add
