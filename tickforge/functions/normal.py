"""The normal distribution, as Arrow functions (SQL has none) and on the driver."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_N = NormalDist()


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(_N.cdf, na_action="ignore")


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """Null outside (0, 1)."""
    return p.map(lambda v: _N.inv_cdf(v) if 0 < v < 1 else None, na_action="ignore")


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0 or null."""
    return part / F.nullif(whole, F.lit(0.0))


#: The normal distribution in SQL, for queries' checks: its power series, within 1e-9 for |x| up to 6.
NORMAL_SQL = "CASE WHEN {x} > 6 THEN 1.0 WHEN {x} < -6 THEN 0.0 ELSE 0.5 + exp(-{x} * {x} / 2) / sqrt(2 * pi()) * list_reduce(list_prepend({{'t': {x}, 's': {x}}}, list_transform(range(1, 120), lambda k: {{'t': CAST(k AS DOUBLE), 's': 0.0::DOUBLE}})), lambda a, b: {{'t': a.t * {x} * {x} / (2 * b.t + 1), 's': a.s + a.t * {x} * {x} / (2 * b.t + 1)}}).s END"
