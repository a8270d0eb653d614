"""Upper tails of the F and chi-square distributions for already aggregated result rows.

Neither Spark SQL nor its ML package has these tails, so a pandas UDF evaluates them on the one
row a test yields.  The helpers are nested so the UDF ships by value, without this package on
the executors.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _make_f_tail():
    import math

    def log_gamma_ratio(a, b):
        """ln(gamma(a + b) / gamma(a)) without subtracting two huge logarithms."""
        shift = sum(math.log((a + b + i) / (a + i)) for i in range(12))
        a += 12

        def series(z):
            return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)

        main = (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b
        return main + series(a + b) - series(a) - shift

    def beta_fraction(a, b, x):
        """Continued fraction of the incomplete beta function, modified Lentz evaluation."""
        tiny = 1e-300
        c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
        value = d
        for m in range(1, 5_000_000):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                         -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1.0 + step * d or tiny)
                c = 1.0 + step / c or tiny
                value *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return value

    def beta_lower(a, b, x, y):
        """Regularised incomplete beta at x, where y = 1 - x is given to keep its digits."""
        if x <= 0.0:
            return 0.0
        if y <= 0.0:
            return 1.0
        big, small = max(a, b), min(a, b)
        log_beta = math.lgamma(small) - log_gamma_ratio(big, small)
        log_x = math.log1p(-y) if y < 0.5 else math.log(x)
        log_y = math.log1p(-x) if x < 0.5 else math.log(y)
        front = math.exp(a * log_x + b * log_y - log_beta)
        if x < (a + 1.0) / (a + b + 2.0):
            return front * beta_fraction(a, b, x) / a
        return 1.0 - front * beta_fraction(b, a, y) / b

    def tail(f, between, within):
        if f is None or math.isnan(f) or between <= 0 or within <= 0:
            return None
        if math.isinf(f):
            return 0.0
        if f <= 0:
            return 1.0
        total = within + between * f
        return beta_lower(within / 2, between / 2, within / total, between * f / total)

    return tail


def _make_chi2_tail():
    import math

    def tail(x, dof):
        if x is None or math.isnan(x):
            return None
        if dof <= 0 or x <= 0:
            return 1.0
        a, z = dof / 2, x / 2
        front = math.exp(a * math.log(z) - z - math.lgamma(a))
        if z < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-17:
                n += 1
                term *= z / n
                total += term
            return 1.0 - front * total
        tiny = 1e-300
        b = z + 1 - a
        c, d = 1 / tiny, 1 / b
        value = d
        for i in range(1, 5_000_000):
            step = -i * (i - a)
            b += 2
            d = 1 / (step * d + b or tiny)
            c = b + step / c or tiny
            value *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return front * value

    return tail


def f_tail(f: str, between: str, within: str) -> Column:
    """P(F > f); null where f is null."""
    tail = _make_f_tail()

    @F.pandas_udf("double")
    def p_value(f: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
        return pd.Series([tail(*row) for row in zip(f, between, within)], dtype="float64")

    return p_value(F.col(f).cast("double"), F.col(between).cast("double"), F.col(within).cast("double"))


def chi2_tail(x: str, dof: str) -> Column:
    """P(X > x) for a chi-square variable; 1 at zero degrees of freedom."""
    tail = _make_chi2_tail()

    @F.pandas_udf("double")
    def p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([tail(*row) for row in zip(x, dof)], dtype="float64")

    return p_value(F.col(x).cast("double"), F.col(dof).cast("double"))
