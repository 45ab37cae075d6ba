"""Mathematical functions of Columns. Those that look at a whole column take a Window, or the table itself, whose aggregate is then worked out once."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import col, missing, numbered


def _guard(c: Column, ok: Column, error: str, what: str) -> Column:
    if error not in ("warn", "raise", "ignore"):
        raise ValueError("error is warn, raise or ignore")
    if error == "raise":
        return F.when(~ok, F.raise_error(F.lit(what)).cast("double")).otherwise(c)
    if error == "warn":
        warnings.warn(f"{what} become null", stacklevel=3)
    return F.when(ok, c)


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it; so the size of nested functions is a sum, not a product."""
    return F.transform(F.array(c), f)[0]


def log(c: Column, error: str = "ignore") -> Column:
    return _guard(F.ln(F.when(c > 0, c)), c > 0, error, "values of 0 and below in log")


def exp(c: Column) -> Column:
    return F.exp(c)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def logit(c: Column, error: str = "ignore") -> Column:
    ok = (c > 0) & (c < 1)
    p = F.when(ok, c)
    return _guard(F.ln(p / (1 - p)), ok, error, "values outside (0, 1) in logit")


def _of_all(f: Callable[[Column], Column], c: Column, over, df: DataFrame | None) -> Column:
    """An aggregate of the window, or of the table: a scalar subquery, so that rows aren't gathered. Without either all rows are one window, in one task."""
    if over is None and df is not None:
        return df.select(f(c)).scalar()
    return f(c).over(Window.partitionBy(F.lit(0)) if over is None else over)


def softmax(c: Column, over=None, df: DataFrame | None = None) -> Column:
    most = _of_all(F.max, c, over, df)
    if over is None and df is not None:
        return F.exp(c - most) / df.select(F.sum(F.exp(c - most))).scalar()
    e = F.exp(c - most)
    return e / F.sum(e).over(Window.partitionBy(F.lit(0)) if over is None else over)


def z_score(c: Column, over=None, df: DataFrame | None = None) -> Column:
    """(x - mean) / standard deviation of the sample; 0 where that is 0."""
    s = _of_all(F.stddev_samp, c, over, df)
    return F.when(s == 0, F.lit(0.0)).otherwise((c - _of_all(F.avg, c, over, df)) / s)


def moments(df: DataFrame, name: str) -> dict[str, float]:
    m, s = df.agg(F.avg(col(name)), F.stddev_samp(col(name))).first()
    return {"mean": m, "std": s}


#: Cody's rational approximations of the error function, numerator and denominator, for |x| up to 0.46875, up to 4 and beyond.
_NEAR = ((1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03), (1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03))
_MID = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03),
    (1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03),
)
_FAR = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))


def _poly(k: tuple, x: Column) -> Column:
    out = F.lit(k[0])
    for a in k[1:]:
        out = out * x + a
    return out


def _ratio(k: tuple, x: Column) -> Column:
    return _poly(k[0], x) / _poly(k[1], x)


def _erfc(x: Column) -> Column:
    def positive(y: Column) -> Column:
        far = F.exp(-y * y) * (1 / math.sqrt(math.pi) - _bound(1 / (y * y), lambda r: r * _ratio(_FAR, r))) / y
        return F.when(y <= 4, F.exp(-y * y) * _ratio(_MID, y)).otherwise(far)

    def signed(x: Column) -> Column:
        tail = _bound(F.abs(x), positive)
        return F.when(F.abs(x) <= 0.46875, 1 - x * _bound(x * x, lambda y: _ratio(_NEAR, y))).when(x < 0, 2 - tail).otherwise(tail)

    return _bound(x, signed)


def normal_cdf(c: Column) -> Column:
    """The normal distribution function, to about 1e-15 of its value: rational approximations of the error function."""
    z = c.cast("double")
    return _bound(z, lambda z: F.when(~F.isnan(z), 0.5 * _erfc(-z / math.sqrt(2))))


#: Wichura's algorithm AS 241: the middle, the tails, the far tails.
_P0 = ((2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608), (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0))
_P1 = ((7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734), (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0))
_P2 = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772), (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0))


def probit(c: Column, error: str = "ignore") -> Column:
    """The normal quantile, to about 1e-15 of its value."""

    def inside(p: Column) -> Column:
        q = p - 0.5
        mid = _bound(0.180625 - q * q, lambda r: _ratio(_P0, r)) * q
        tail = _bound(F.sqrt(-F.ln(F.least(p, 1 - p))), lambda r: F.when(r <= 5, _ratio(_P1, r - 1.6)).otherwise(_ratio(_P2, r - 5.0)))
        return F.when(F.abs(q) <= 0.425, mid).otherwise(F.signum(q) * tail)

    def checked(p: Column) -> Column:
        ok = (p > 0) & (p < 1)
        return _guard(_bound(F.when(ok, p), inside), ok, error, "values outside (0, 1) in probit")

    return _bound(c.cast("double"), checked)


def ecdf(df: DataFrame, name: str) -> DataFrame:
    """(x, y): the sorted values and each one's share of rows up to it; missing values are an error."""
    if not df.where(missing(df, name)).isEmpty():
        raise ValueError("the column has missing values")
    n = df.count()
    return numbered(df.select(col(name).alias("x")), "y", [F.col("x")]).withColumn("y", (F.col("y") + 1) / F.lit(max(n, 1)))
