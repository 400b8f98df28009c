"""Derived churn features as Spark column expressions.

All requested features are added in one projection (``withColumns``), so
Catalyst fuses them into the scan's whole-stage-codegen span and prunes the
inputs that no requested feature needs.

Null handling: binary flags treat an unknown input as False (as a pandas
comparison does); continuous features propagate null.  Where pandas would
give +/-inf or NaN (division by zero, log of x <= -1) the result is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINARY = "binary"
CONTINUOUS = "continuous"


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    kind: str
    inputs: tuple[str, ...]
    build: Callable[..., Column]


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def _div(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def _log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x))


# ---------------------------------------------------------------------------
# Feature names, inputs and formulas of the churn feature set.
# Binary (10):
#   is_silver            Card Type = 'SILVER'
#   is_germany           Geography = 'Germany'
#   is_spain             Geography = 'Spain'
#   is_france            Geography = 'France'
#   no_balance           Balance < 2500
#   middle_age           25 < Age < 45
#   Num_Of_Products_1..4 NumOfProducts = 1 .. 4
# Continuous (20):
#   Age_x_IsActive       Age * IsActiveMember
#   Balance_x_Tenure     Balance * Tenure
#   CreditScore_x_Age    CreditScore * Age
#   Balance_to_Salary    Balance / (EstimatedSalary + 1)
#   Balance_per_Product  Balance / (NumOfProducts + 1)
#   Salary_per_Product   EstimatedSalary / (NumOfProducts + 1)
#   CreditScore_per_Age  CreditScore / (Age + 1)
#   Tenure_per_Age       Tenure / (Age + 1)
#   Inactive_x_Balance   (1 - IsActiveMember) * Balance
#   Inactive_x_Age       (1 - IsActiveMember) * Age
#   Products_x_Active    NumOfProducts * IsActiveMember
#   Balance_plus_Salary  Balance + EstimatedSalary
#   WealthScore          0.6 * Balance + 0.4 * EstimatedSalary
#   LogBalance           log1p(Balance)
#   LogAge               log1p(Age)
#   Age2                 Age ** 2
#   Balance2             Balance ** 2
#   Tenure2              Tenure ** 2
#   Products_per_Tenure  NumOfProducts / (Tenure + 1)
#   Balance_per_Tenure   Balance / (Tenure + 1)
# ---------------------------------------------------------------------------
_FIXED: list[FeatureSpec] = [
    FeatureSpec("is_silver", BINARY, ("Card Type",),
                lambda c, silver="SILVER": F.col(c) == silver),
    FeatureSpec("is_germany", BINARY, ("Geography",),
                lambda c, value="Germany": F.col(c) == value),
    FeatureSpec("is_spain", BINARY, ("Geography",),
                lambda c, value="Spain": F.col(c) == value),
    FeatureSpec("is_france", BINARY, ("Geography",),
                lambda c, value="France": F.col(c) == value),
    FeatureSpec("no_balance", BINARY, ("Balance",),
                lambda b: F.col(b) < 2500),
    FeatureSpec("middle_age", BINARY, ("Age",),
                lambda a: (F.col(a) > 25) & (F.col(a) < 45)),
    FeatureSpec("Num_Of_Products_1", BINARY, ("NumOfProducts",), lambda p: F.col(p) == 1),
    FeatureSpec("Num_Of_Products_2", BINARY, ("NumOfProducts",), lambda p: F.col(p) == 2),
    FeatureSpec("Num_Of_Products_3", BINARY, ("NumOfProducts",), lambda p: F.col(p) == 3),
    FeatureSpec("Num_Of_Products_4", BINARY, ("NumOfProducts",), lambda p: F.col(p) == 4),
    FeatureSpec("Age_x_IsActive", CONTINUOUS, ("Age", "IsActiveMember"),
                lambda a, m: _d(a) * _d(m)),
    FeatureSpec("Balance_x_Tenure", CONTINUOUS, ("Balance", "Tenure"),
                lambda b, t: _d(b) * _d(t)),
    FeatureSpec("CreditScore_x_Age", CONTINUOUS, ("CreditScore", "Age"),
                lambda s, a: _d(s) * _d(a)),
    FeatureSpec("Balance_to_Salary", CONTINUOUS, ("Balance", "EstimatedSalary"),
                lambda b, s: _div(_d(b), _d(s) + 1)),
    FeatureSpec("Balance_per_Product", CONTINUOUS, ("Balance", "NumOfProducts"),
                lambda b, p: _div(_d(b), _d(p) + 1)),
    FeatureSpec("Salary_per_Product", CONTINUOUS, ("EstimatedSalary", "NumOfProducts"),
                lambda s, p: _div(_d(s), _d(p) + 1)),
    FeatureSpec("CreditScore_per_Age", CONTINUOUS, ("CreditScore", "Age"),
                lambda s, a: _div(_d(s), _d(a) + 1)),
    FeatureSpec("Tenure_per_Age", CONTINUOUS, ("Tenure", "Age"),
                lambda t, a: _div(_d(t), _d(a) + 1)),
    FeatureSpec("Inactive_x_Balance", CONTINUOUS, ("IsActiveMember", "Balance"),
                lambda m, b: (1 - _d(m)) * _d(b)),
    FeatureSpec("Inactive_x_Age", CONTINUOUS, ("IsActiveMember", "Age"),
                lambda m, a: (1 - _d(m)) * _d(a)),
    FeatureSpec("Products_x_Active", CONTINUOUS, ("NumOfProducts", "IsActiveMember"),
                lambda p, m: _d(p) * _d(m)),
    FeatureSpec("Balance_plus_Salary", CONTINUOUS, ("Balance", "EstimatedSalary"),
                lambda b, s: _d(b) + _d(s)),
    FeatureSpec("WealthScore", CONTINUOUS, ("Balance", "EstimatedSalary"),
                lambda b, s: 0.6 * _d(b) + 0.4 * _d(s)),
    FeatureSpec("LogBalance", CONTINUOUS, ("Balance",), lambda b: _log1p(_d(b))),
    FeatureSpec("LogAge", CONTINUOUS, ("Age",), lambda a: _log1p(_d(a))),
    FeatureSpec("Age2", CONTINUOUS, ("Age",), lambda a: _d(a) * _d(a)),
    FeatureSpec("Balance2", CONTINUOUS, ("Balance",), lambda b: _d(b) * _d(b)),
    FeatureSpec("Tenure2", CONTINUOUS, ("Tenure",), lambda t: _d(t) * _d(t)),
    FeatureSpec("Products_per_Tenure", CONTINUOUS, ("NumOfProducts", "Tenure"),
                lambda p, t: _div(_d(p), _d(t) + 1)),
    FeatureSpec("Balance_per_Tenure", CONTINUOUS, ("Balance", "Tenure"),
                lambda b, t: _div(_d(b), _d(t) + 1)),
]

_REGISTRY: dict[str, FeatureSpec] = {f.name: f for f in _FIXED}


def register_feature(name: str, kind: str, inputs: tuple[str, ...] | list[str],
                     build: Callable[..., Column]) -> None:
    """Add a user feature: ``build(*input_column_names) -> Column``."""
    if kind not in (BINARY, CONTINUOUS):
        raise ValueError("kind must be 'binary' or 'continuous'")
    _REGISTRY[name] = FeatureSpec(name, kind, tuple(inputs), build)


def unregister_feature(name: str) -> None:
    """Remove a user feature (the fixed set cannot be removed)."""
    if name in {f.name for f in _FIXED}:
        raise ValueError(f"{name!r} is a built-in feature")
    _REGISTRY.pop(name, None)


def fixed_features() -> list[str]:
    """The 30 built-in features in default order (binary, then continuous,
    each alphabetical), regardless of user registrations."""
    b = sorted(f.name for f in _FIXED if f.kind == BINARY)
    c = sorted(f.name for f in _FIXED if f.kind == CONTINUOUS)
    return b + c


def binary_features() -> list[str]:
    """Binary feature names, alphabetical (feature discovery)."""
    return sorted(n for n, f in _REGISTRY.items() if f.kind == BINARY)


def continuous_features() -> list[str]:
    return sorted(n for n, f in _REGISTRY.items() if f.kind == CONTINUOUS)


def all_features() -> list[str]:
    """Default order: binary first, then continuous, each alphabetical."""
    return binary_features() + continuous_features()


def spec(name: str) -> FeatureSpec:
    return _REGISTRY[name]


def required_features(layout_columns: list[str]) -> list[str]:
    """Names in a layout that are engineered features (pruning: only these
    are computed), in layout order."""
    return [c for c in layout_columns if c in _REGISTRY]


def feature_column(name: str, columns: dict[str, str] | None = None,
                   **params) -> Column:
    """One feature as a Column; ``columns`` renames inputs (churn name ->
    actual column), ``params`` overrides category literals."""
    f = _REGISTRY[name]
    cols = columns or {}
    expr = f.build(*[cols.get(c, c) for c in f.inputs], **params)
    if f.kind == BINARY:
        expr = F.coalesce(expr, F.lit(False))
    return expr


def add_features(df: DataFrame, selected: list[str] | None = None,
                 columns: dict[str, str] | None = None,
                 categories: dict[str, str] | None = None,
                 ignore_unknown: bool = False) -> DataFrame:
    """Append derived features to ``df`` (input columns are kept).

    selected   feature names in output order; None means all.
    columns    maps churn column names to the table's names.
    categories overrides for the category literals, e.g.
               {"is_germany": "EUROPE", "is_silver": "AUTOMOBILE"}.
    """
    names = all_features() if selected is None else list(selected)
    unknown = [n for n in names if n not in _REGISTRY]
    if unknown and not ignore_unknown:
        raise ValueError(f"unknown features: {unknown}")
    cats = categories or {}
    exprs = {}
    for n in names:
        if n not in _REGISTRY:
            continue
        params = {}
        if n in cats:
            params = {"silver" if n == "is_silver" else "value": cats[n]}
        exprs[n] = feature_column(n, columns, **params)
    return df.withColumns(exprs)
