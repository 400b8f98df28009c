"""Arrow-batched helpers for the few scalar computations SQL cannot
express.  (No postponed annotations here: pandas UDF type hints must be
real types.)"""

import pandas as pd
from pyspark.sql import functions as F

from driftwood.functions.stats import ks_exact_sf


@F.pandas_udf("double")
def ks_exact_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact two-sided KS p-value per (D, n1, n2) row: one row per tested
    feature, so the batch is tiny."""
    return pd.Series([ks_exact_sf(float(a), int(b), int(c)) if pd.notna(a) else None
                      for a, b, c in zip(d, n1, n2)], dtype="float64")
