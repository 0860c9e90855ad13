"""z-score and the normal survival function as Column expressions.

Neither Spark nor DuckDB has ``erf``; the survival function is built from W. J.
Cody's rational Chebyshev approximation of erfc (Math. Comp. 23, 1969), which keeps
full relative precision deep in the tail (p about 1e-123 at z = 23.6), where
``1 - Phi(z)`` by subtraction would return 0.

The same SQL text runs in Spark SQL and DuckDB: only CASE, abs, exp, sqrt and
DOUBLE literals written with an exponent (``1.5e0``; plain ``1.5`` is DECIMAL in
Spark SQL).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cody (1969) erfc coefficients, in the published order.
_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02,
      3.20937758913846947e03, 1.85777706184603153e-1)
_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03,
      2.84423683343917062e03)
_C = (5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01,
      2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03,
      2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
_D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02,
      1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03,
      3.43936767414372164e03, 1.23033935480374942e03)
_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
      1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1,
      6.05183413124413191e-2, 2.33520497626869185e-3)


def _lit(v: float) -> str:
    return repr(float(v)) if "e" in repr(float(v)) else f"{float(v)!r}e0"


def _horner(var: str, top: float, coeffs, last: float, denom_coeffs, denom_last: float):
    """Cody's interleaved Horner evaluation: returns (numerator, denominator) SQL."""
    n = f"({_lit(top)} * {var})"
    d = var
    for a, b in zip(coeffs, denom_coeffs):
        n = f"(({n} + {_lit(a)}) * {var})"
        d = f"(({d} + {_lit(b)}) * {var})"
    return f"({n} + {_lit(last)})", f"({d} + {_lit(denom_last)})"


def erfc_sql(x: str, y: str | None = None, s: str | None = None) -> str:
    """SQL text of erfc(x) for a DOUBLE expression ``x`` (read several times: pass
    column names). ``y`` = abs(x) and ``s`` = y * y may be given as columns too."""
    y = y or f"abs({x})"
    s = s or f"({y} * {y})"
    n1, d1 = _horner(s, _A[4], _A[:3], _A[3], _B[:3], _B[3])
    small = f"(1.0e0 - {x} * {n1} / {d1})"
    n2, d2 = _horner(y, _C[8], _C[:7], _C[7], _D[:7], _D[7])
    mid = f"(exp(-{s}) * {n2} / {d2})"
    inv = f"(1.0e0 / {s})"
    n3, d3 = _horner(inv, _P[5], _P[:4], _P[4], _Q[:4], _Q[4])
    big = f"(({_lit(1.0 / math.sqrt(math.pi))} - {inv} * {n3} / {d3}) / {y} * exp(-{s}))"
    r = f"(CASE WHEN {y} <= 4.0e0 THEN {mid} ELSE {big} END)"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {y} <= 4.6875e-1 THEN {small} "
            f"WHEN {x} < 0.0e0 THEN 2.0e0 - {r} ELSE {r} END)")


def normal_sf_sql(z: str) -> str:
    """SQL text of the upper tail P(Z > z) = erfc(z / sqrt 2) / 2."""
    x = f"({z} * {_lit(1.0 / math.sqrt(2.0))})"
    return f"(5.0e-1 * {erfc_sql(x)})"


def with_normal_sf(df, z: str, out: str):
    """Add ``out`` = P(Z > z) to a DataFrame. x, |x| and x*x are projected first so
    the rational function reads columns: the expression stays small enough for
    whole-stage codegen even with several p-values in one stage."""
    x, y, s = f"_{out}_x", f"_{out}_y", f"_{out}_s"
    df = df.withColumn(x, F.col(z) * F.lit(1.0 / math.sqrt(2.0)))
    df = df.withColumn(y, F.abs(F.col(x))).withColumn(s, F.abs(F.col(x)) * F.abs(F.col(x)))
    df = df.withColumn(out, F.expr(f"5.0e-1 * {erfc_sql(f'`{x}`', f'`{y}`', f'`{s}`')}"))
    return df.drop(x, y, s)


def normal_sf(z: Column | str) -> Column:
    """Column P(Z > z); ``z`` should be a column reference (it is read several times)."""
    name = z if isinstance(z, str) else None
    if name is None:
        raise TypeError("normal_sf needs a column name; select z first")
    return F.expr(normal_sf_sql(f"`{name}`"))


def z_score(green: Column, total: Column, gamma: float) -> Column:
    """(g - gamma T) / sqrt(T gamma (1 - gamma)) on doubles."""
    g = green.cast("double")
    t = total.cast("double")
    return (g - F.lit(float(gamma)) * t) / F.sqrt(t * F.lit(float(gamma)) * F.lit(1.0 - float(gamma)))


def z_score_sql(green: str, total: str, gamma: float) -> str:
    g = f"CAST({green} AS DOUBLE)"
    t = f"CAST({total} AS DOUBLE)"
    return (f"(({g} - {_lit(gamma)} * {t}) / sqrt({t} * {_lit(gamma)} * {_lit(1.0 - gamma)}))")
