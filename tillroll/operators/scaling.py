"""Standard scaling (M3) as column expressions.

Moments come from one global aggregation (partial per partition, then a single
tiny merge).  The population standard deviation is used, as in the reference;
``ddof=1`` gives Spark ML's ``StandardScaler`` convention.  Mean and std are
kept on a 1e-6 grid so the scaled values do not depend on the summation order
of the cluster (they are then identical in any engine); a zero std maps the
feature to 0.

``z_milli`` columns hold ``floor(z * 1000)`` as bigint — the integer space the
deterministic K-Means works in.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = 1e6


def _grid(c):
    return F.floor(c * F.lit(GRID) + F.lit(0.5)) / F.lit(GRID)


@dataclass
class ScalerModel:
    features: list[str]
    means: list[float]
    stds: list[float]

    def transform(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        cols = {}
        for f, m, s in zip(self.features, self.means, self.stds):
            x = F.col(f).cast("double")
            cols[f"{prefix}{f}"] = F.lit(0.0) if not s else (x - F.lit(m)) / F.lit(s)
        out = df.withColumns(cols)
        return out.withColumns({f"{prefix}{f}_milli": F.floor(F.col(f"{prefix}{f}") * 1000).cast("bigint")
                                for f in self.features})


def moments(df: DataFrame, features: list[str], ddof: int = 0, grid: bool = True) -> DataFrame:
    """One row: ``<f>__mean``, ``<f>__std`` per feature (grid-rounded unless ``grid`` is off)."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    keep = _grid if grid else (lambda c: c)
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs += [keep(F.avg(x)).alias(f"{f}__mean"), keep(std(x)).alias(f"{f}__std")]
    return df.agg(*aggs)


def fit_scaler(df: DataFrame, features: list[str], ddof: int = 0, grid: bool = True) -> ScalerModel:
    row = moments(df, features, ddof, grid).first()  # a single row of 2 x features numbers
    return ScalerModel(list(features), [row[f"{f}__mean"] for f in features],
                       [row[f"{f}__std"] for f in features])


def standard_scale(df: DataFrame, features: list[str], ddof: int = 0, prefix: str = "z_") -> DataFrame:
    """Scaled columns ``z_<f>`` (double) and ``z_<f>_milli`` (bigint) in one lazy
    plan: the moments are a cross-partition aggregate, applied as literals."""
    return fit_scaler(df, features, ddof).transform(df, prefix)
