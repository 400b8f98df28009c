"""Distribution tail functions as SQL expressions.

They are applied to one row per tested feature, after all heavy work is
done, and are written as plain arithmetic (exp, ln, sqrt, CASE) so that the
same text runs in Spark SQL and in DuckDB.

* ``erfc_sql``: complementary error function.  z < 3: positive-term series
  erf(z) = 2/sqrt(pi) * exp(-z^2) * sum_n 2^n z^(2n+1) / (1*3*...*(2n+1));
  z >= 3: Laplace continued fraction, evaluated bottom-up.
* ``chi2_sf``: chi-square survival function for integer dof via the closed
  forms (even dof: Poisson sum; odd dof: erfc plus a half-integer sum).
* ``ks_sf_sql``: asymptotic two-sample Kolmogorov-Smirnov p-value,
  Q(lambda) = 2 sum_k (-1)^(k-1) exp(-2 k^2 lambda^2), lambda = sqrt(n_e) D,
  n_e = n1 n2 / (n1 + n2); 1 when lambda < 0.2 (series not yet converged).
* ``ks_finite_*``: P(D_n >= d) of the one-sample statistic at the finite
  n = round(n_e), to 1e-6 at any n.  Up to ``FINITE_EXACT`` by exact formulas:
  the lattice matrix of Durbin (applied n times to a vector), or twice the
  one-sided Smirnov sum where n d^2 >= ``FINITE_TAIL`` (both sides at once have
  probability below 1e-7 there).  Beyond, the expansion of Pelz and Good: the
  Kolmogorov series with corrections up to n^(-3/2).
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

_SERIES_TERMS = 60
_CF_DEPTH = 60
_KS_TERMS = 40


def erfc_sql(z: str) -> str:
    """erfc(z) for z >= 0 as SQL text (``z`` is an SQL expression)."""
    zz = f"(({z})*({z}))"
    series = "1.0"
    for n in range(_SERIES_TERMS, 0, -1):
        series = f"(1.0 + 2.0*{zz}/{2 * n + 1}.0*{series})"
    small = f"(1.0 - 2.0/sqrt(pi())*exp(-{zz})*({z})*{series})"
    cf = f"({z})"
    for k in range(_CF_DEPTH, 0, -1):
        cf = f"(({z}) + {k / 2!r}/{cf})"
    large = f"(exp(-{zz})/sqrt(pi())/{cf})"
    return f"(CASE WHEN ({z}) < 3.0 THEN {small} ELSE {large} END)"


def ks_sf_sql(d: str, n1: str, n2: str) -> str:
    """Asymptotic two-sample KS p-value as SQL text."""
    lam = f"(sqrt(({n1})*({n2})/(({n1})+({n2})))*({d}))"
    terms = " + ".join(
        f"{'-' if k % 2 == 0 else ''}exp(-2.0*{k * k}.0*{lam}*{lam})"
        for k in range(1, _KS_TERMS + 1))
    return (f"(CASE WHEN ({d}) IS NULL OR ({n1}) = 0 OR ({n2}) = 0 THEN NULL "
            f"WHEN {lam} < 0.2 THEN 1.0 "
            f"ELSE least(1.0, greatest(0.0, 2.0*({terms}))) END)")


def ks_lambda(d: str, n1: str, n2: str) -> Column:
    """lambda = sqrt(n1 n2 / (n1 + n2)) D, to be projected as its own column
    before ``ks_sf_from_lambda`` (keeps the series' expression small)."""
    return F.sqrt(F.col(n1).cast("double") * F.col(n2) / (F.col(n1) + F.col(n2))) * F.col(d)


def ks_sf_from_lambda(lam: str, d: str, n1: str, n2: str) -> Column:
    """The asymptotic series on an already projected lambda column."""
    L = F.col(lam)
    series = None
    for k in range(1, _KS_TERMS + 1):
        term = F.exp(-2.0 * k * k * L * L)
        series = term if series is None else (series - term if k % 2 == 0 else series + term)
    return (F.when(F.col(d).isNull() | (F.col(n1) == 0) | (F.col(n2) == 0), F.lit(None).cast("double"))
            .when(L < 0.2, F.lit(1.0))
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series))))


def ks_sf(d: str, n1: str, n2: str) -> Column:
    """Asymptotic KS p-value from the named statistic and sample-size columns
    (single expression; for many rows prefer ks_lambda + ks_sf_from_lambda)."""
    return F.expr(ks_sf_sql(f"`{d}`", f"`{n1}`", f"`{n2}`"))


FINITE_EXACT = 400   # largest n that exact formulas take
FINITE_TAIL = 2.2    # n d^2 from which the one-sided sum is used there
_PELZ_TERMS = 20


def pelz_good_term_sql(k: str, n: str, z: str) -> str:
    """Term ``k`` >= 0 of the expansion of P(D_n <= z / sqrt(n)) as SQL text
    (both signs of the summation index together)."""
    a = f"(pi()*pi()*(({k})+0.5)*(({k})+0.5))"
    b = f"(pi()*pi()*({k})*({k}))"
    w = lambda p: f"pow({z}, {p})"
    half = (f"1.0/({z}) + ({a} - {w(2)})/(6.0*{w(4)}*sqrt({n}))"
            f" + (6.0*{w(6)} + 2.0*{w(4)} + {a}*(2.0*{w(4)} - 5.0*{w(2)}) + {a}*{a}*(1.0 - 2.0*{w(2)}))"
            f"/(72.0*{w(7)}*({n}))"
            f" + ({a}*{a}*{a}*(5.0 - 30.0*{w(2)}) + {a}*{a}*(212.0*{w(4)} - 60.0*{w(2)})"
            f" + {a}*(135.0*{w(4)} - 96.0*{w(6)}) - 30.0*{w(6)} - 90.0*{w(8)})/(6480.0*{w(10)}*pow({n}, 1.5))")
    whole = (f"(3.0*{b}*{w(2)} - {b}*{b})/(108.0*{w(6)}*pow({n}, 1.5)) - {b}/(36.0*{w(3)}*({n}))")
    return (f"(sqrt(2.0*pi())*(exp(-{a}/(2.0*{w(2)}))*({half}) + exp(-{b}/(2.0*{w(2)}))*({whole})))")


def ks_finite_prepare(d: str, n1: str, n2: str) -> list[Column]:
    """Columns that ``ks_finite_sf`` needs, projected once: n, z = sqrt(n) d,
    and (where the matrix is used) its middle k and its rows."""
    n = F.greatest(F.lit(1.0), F.rint(F.col(n1).cast("double") * F.col(n2) / (F.col(n1) + F.col(n2))))
    return [n.alias("_kf_n"), (F.sqrt(n) * F.col(d)).alias("_kf_z")]


def _durbin_rows(n: Column, d: Column) -> Column:
    """The matrix H of size 2k - 1, k = floor(n d) + 1, with n! / n^n H^n[k, k]
    = P(D_n < d)."""
    k = F.floor(n * d) + 1
    m = 2 * k - 1
    h = k - n * d
    inverse = F.array(*[F.lit(1.0 / math.factorial(i)) for i in range(2 * _durbin_size() + 2)])
    corner = F.when(2 * h > 1, F.pow(2 * h - 1, m)).otherwise(0.0)

    def cell(i: Column, j: Column) -> Column:
        plain = F.when(i - j + 1 < 0, 0.0).otherwise(1.0)
        left = F.when(j == 0, F.pow(h, i + 1)).otherwise(0.0)
        low = F.when(i == m - 1, F.pow(h, m - j)).otherwise(0.0)
        both = F.when((j == 0) & (i == m - 1), corner).otherwise(0.0)
        return (plain - left - low + both) * F.get(inverse, F.greatest(i - j + 1, F.lit(0)).cast("int"))

    at = F.sequence(F.lit(0), (m - 1).cast("int"))
    return F.transform(at, lambda i: F.transform(at, lambda j: cell(i, j)))


def _durbin_size() -> int:
    """Largest k of the matrix: beyond, the one-sided sum is used."""
    return math.floor(math.sqrt(FINITE_TAIL * FINITE_EXACT)) + 1


def _smirnov_sum(n: Column, d: Column) -> Column:
    """P(D_n^+ >= d) = d sum_j C(n, j) (d + j/n)^(j-1) (1 - d - j/n)^(n-j)."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("ln_c"))

    def step(acc: Column, j: Column) -> Column:
        left = 1 - d - j / n
        term = F.when(left > 0, F.exp(acc["ln_c"] + (j - 1) * F.log(d + j / n) + (n - j) * F.log(left))).otherwise(0.0)
        return F.struct((acc["sum"] + term).alias("sum"),
                        (acc["ln_c"] + F.when(j < n, F.log((n - j) / (j + 1))).otherwise(0.0)).alias("ln_c"))

    return d * F.aggregate(F.sequence(F.lit(0), F.floor(n * (1 - d)).cast("int")), zero, step, lambda acc: acc["sum"])


def ks_finite_sf(d: str, n1: str, n2: str) -> Column:
    """P(D_n >= d) on columns from ``ks_finite_prepare``; null without rows on
    either side."""
    n, z, x = F.col("_kf_n"), F.col("_kf_z"), F.col(d)
    small, tail = n <= FINITE_EXACT, z * z >= FINITE_TAIL
    matrix = F.when(small & ~tail, _durbin_rows(n, x))
    k = (F.floor(n * x) + 1).cast("int")
    start = F.transform(F.sequence(F.lit(1), 2 * k - 1), lambda i: F.when(i == k, 1.0).otherwise(0.0))
    dot = lambda row, v: F.aggregate(F.zip_with(row, v, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    # binds the matrix to a name, so that it is built once and not per step
    exact = F.element_at(F.transform(F.array(F.struct(matrix.alias("rows"))), lambda box: F.element_at(F.aggregate(
        F.sequence(F.lit(1), n.cast("int")), start,
        lambda v, s: F.transform(box["rows"], lambda row: dot(row, v) * s / n)), k)), 1)
    terms = F.expr(f"aggregate(sequence(0, {_PELZ_TERMS - 1}), 0D, (acc, k) -> acc + "
                   f"{pelz_good_term_sql('k', '_kf_n', '_kf_z')})")
    far = 2 * F.exp(-F.pow(6 * n * x + 1, 2) / (18 * n))
    p = (F.when(small & tail, 2 * _smirnov_sum(n, x))
         .when(small, 1 - exact)
         .when(z >= 5, far)
         .otherwise(1 - terms))
    return (F.when(x.isNull() | (F.col(n1) == 0) | (F.col(n2) == 0), F.lit(None).cast("double"))
            .when((x <= 1 / (2 * n)) | (z < 0.2), F.lit(1.0))
            .when(x >= 1, F.lit(0.0))
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))


def chi2_prepare(x: str, dof: str) -> list[Column]:
    """Columns the chi-square tail needs, projected once: y = x/2, z =
    sqrt(y), zz = y, ln y."""
    y = F.col(x) / 2.0
    return [y.alias("_c2_y"), F.sqrt(y).alias("_c2_z"), F.log(y).alias("_c2_lny")]


def chi2_sf_prepared(x: str, dof: str) -> Column:
    """P(X > x), X ~ chi-square(dof), on columns from ``chi2_prepare``."""
    return _chi2_sf(F.col(x), F.col(dof), F.col("_c2_y"), F.col("_c2_z"), F.col("_c2_lny"))


def chi2_sf(x: Column, dof: Column) -> Column:
    """P(X > x) for X ~ chi-square(dof), integer dof >= 1; dof 0 gives 1.
    Single expression (the inner values are repeated inside it); for many
    rows prefer chi2_prepare + chi2_sf_prepared."""
    y = x / 2.0
    return _chi2_sf(x, dof, y, F.sqrt(y), F.log(y))


def _chi2_sf(x: Column, dof: Column, y: Column, z: Column, ln_y: Column) -> Column:
    m_even = F.floor(dof / 2).cast("int")        # terms i = 0 .. m-1
    m_odd = F.floor((dof - 1) / 2).cast("int")   # terms i = 1 .. m

    def _sum(m: Column, first: Column, step_den) -> Column:
        # sum of exp(l_i - y) with l_1 = first, l_i = l_{i-1} + ln y - ln(den_i)
        init = F.struct(F.lit(0.0).alias("s"), first.alias("l"))
        acc = F.aggregate(
            F.sequence(F.lit(1), F.greatest(m, F.lit(1))), init,
            lambda a, i: F.struct(
                (a["s"] + F.exp(a["l"] - y)).alias("s"),
                (a["l"] + ln_y - F.log(step_den(i))).alias("l")),
            lambda a: a["s"])
        return F.when(m >= 1, acc).otherwise(F.lit(0.0))

    even = _sum(m_even, F.lit(0.0), lambda i: i.cast("double"))
    # l_1 = 0.5 ln y - ln Gamma(1.5); next denominators i + 0.5 for i >= 1
    odd = _erfc_col(z) + _sum(m_odd, 0.5 * ln_y - F.log(F.lit(0.886226925452758)),
                              lambda i: i.cast("double") + 0.5)
    res = F.when(dof % 2 == 0, even).otherwise(odd)
    return (F.when(x.isNull() | dof.isNull(), F.lit(None).cast("double"))
            .when(dof <= 0, F.lit(1.0))
            .when(x <= 0, F.lit(1.0))
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), res))))


def _erfc_col(z: Column) -> Column:
    """erfc as a Column (same formula as ``erfc_sql``)."""
    zz = z * z
    series = F.lit(1.0)
    for n in range(_SERIES_TERMS, 0, -1):
        series = 1.0 + 2.0 * zz / float(2 * n + 1) * series
    small = 1.0 - 2.0 / 1.7724538509055159 * F.exp(-zz) * z * series
    cf = z
    for k in range(_CF_DEPTH, 0, -1):
        cf = z + (k / 2) / cf
    large = F.exp(-zz) / 1.7724538509055159 / cf
    return F.when(z < 3.0, small).otherwise(large)


def chi2_sf_even_sql(x: str, dof: int) -> str:
    """Closed form for an even, known dof (oracle text)."""
    assert dof % 2 == 0 and dof > 0
    y = f"(({x})/2.0)"
    terms = ["1.0"]
    fact = 1
    for i in range(1, dof // 2):
        fact *= i
        terms.append(f"pow({y}, {i})/{fact}.0")
    return f"(exp(-{y})*({' + '.join(terms)}))"


def chi2_sf_dof1_sql(x: str) -> str:
    return erfc_sql(f"sqrt(({x})/2.0)")


#: Diagonals between two rescalings of the path counts.
_PATH_BLOCK = 512


def ks_exact_sf(d: float, n1: int, n2: int) -> float:
    """Exact two-sided P(D >= d) for the two-sample KS statistic.

    All C(n, n1) orderings of the pooled sample (n = n1 + n2) are equally likely
    under the null: lattice paths from (0,0) to (n1,n2).  Paths are counted that
    stay strictly inside |i n2 - j n1| < h = d n1 n2, a band of 2 h / n cells on
    every diagonal.  The band is the same seen from either end, so the counts of
    the middle diagonal, paired with themselves, give all paths.  A step to the
    right weighs n1 / n2 to keep the counts of a diagonal of one size; the weight
    and the powers of two taken out are put back in decimals.

    By Hoeffding's bound for draws without replacement, over all diagonals,
    P(D >= d) <= 2 n exp(-4 (h / n)^2 / n); where that is below 1e-18 the answer
    is 0.  So a band has at most about sqrt(n (ln 2n + 41)) cells: time
    O(n^1.5 sqrt(ln n)) at worst, n x band else, memory O(band).
    """
    import numpy as np

    if n1 <= 0 or n2 <= 0 or d is None:
        return float("nan")
    n1, n2 = min(n1, n2), max(n1, n2)
    n, h = n1 + n2, int(round(d * n1 * n2))
    if h <= 0:
        return 1.0
    if math.log(2 * n) - 4 * (h / n) ** 2 / n < math.log(1e-18):
        return 0.0
    weight, half = n1 / n2, n // 2
    low = lambda s: max(0, (s * n1 - h) // n + 1)
    high = lambda s: min(s, n1, (s * n1 + h - 1) // n)
    widest = min(n1, 2 * h // n + 1) + 2
    counts, moved = np.zeros(widest + _PATH_BLOCK + 2), np.empty(widest + _PATH_BLOCK + 2)
    counts[1], base, first, last, twos = 1.0, -1, 0, 0, 0  # cell i at counts[i - base]

    def step(s: int) -> bool:
        nonlocal first, last
        lo, hi = low(s), high(s)
        if lo > hi:
            return False
        a, b = lo - base, hi - base + 1
        right = np.multiply(counts[a - 1:b - 1], weight, out=moved[:b - a])
        here = counts[a:b]
        np.add(here, right, out=here)
        counts[first - base:a] = 0.0
        first, last = lo, hi
        return True

    for s in range(1, half + 1):
        if not step(s):
            return 1.0
        if s % _PATH_BLOCK == 0:
            kept = counts[first - base:last - base + 1].copy()
            power = math.frexp(kept.max())[1]
            twos += power
            counts[:] = 0.0
            base = first - 1
            counts[1:len(kept) + 1] = np.ldexp(kept, -power)
    middle, at = counts[first - base:last - base + 1].copy(), first
    if n % 2 and not step(half + 1):
        return 1.0
    # (i, middle diagonal) meets (n1 - i, its mirror image)
    lo, hi = max(at, n1 - last), min(at + len(middle) - 1, n1 - first)
    if lo > hi:
        return 1.0
    mirror = counts[n1 - hi - base:n1 - lo - base + 1][::-1]
    pairs = float(np.dot(middle[lo - at:hi - at + 1], mirror))
    if pairs <= 0:
        return 1.0
    with localcontext() as c:
        c.prec = 50
        inside = (Decimal(pairs).ln() + 2 * twos * Decimal(2).ln() - n1 * Decimal(weight).ln()
                  - (_ln_factorial(n) - _ln_factorial(n1) - _ln_factorial(n2))).exp()
        return float(min(Decimal(1), max(Decimal(0), 1 - inside)))


def _ln_factorial(k: int) -> Decimal:
    """ln k! to about 30 places (Stirling's series from 64 on)."""
    if k < 64:
        return Decimal(math.factorial(k)).ln()
    z = Decimal(k + 1)
    terms = [(1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400)]
    return ((z - Decimal("0.5")) * z.ln() - z + Decimal("0.9189385332046727417803297364056176398613974736377834")
            + sum(Decimal(a) / b / z ** (2 * i + 1) for i, (a, b) in enumerate(terms)))
