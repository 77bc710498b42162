"""Scalar functions that Spark lacks, as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Cody's rational approximations of erf and erfc (1969),
# for |x| <= 0.46875, up to 4, and beyond.
ERF_P = (3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02, 3.16112374387056560e00, 1.85777706184603153e-1)
ERF_Q = (2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02, 2.36012909523441209e01)
ERFC_P = (
    1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03, 8.81952221241769090e02, 2.98635138197400131e02,
    6.61191906371416295e01, 8.88314979438837594e00, 5.64188496988670089e-1, 2.15311535474403846e-8,
)
ERFC_Q = (
    1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03, 3.29079923573345963e03, 1.62138957456669019e03,
    5.37181101862009858e02, 1.17693950891312499e02, 1.57449261107098347e01,
)
FAR_P = (6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2)
FAR_Q = (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346725e00, 2.56852019228982242e00)
ONE_OVER_SQRT_PI = 5.6418958354775628695e-1


def _poly(x: str, lowest_first: tuple[float, ...]) -> str:
    out = repr(lowest_first[-1]) + "{D}"
    for c in reversed(lowest_first[:-1]):
        out = f"({out} * {x} + {c!r}{{D}})"
    return out


def normal_cdf_sql(z: str, double: str = "D") -> str:
    """SQL text of the normal distribution function of ``z``, for Spark; ``double=""`` gives DuckDB's."""
    y = f"(abs({z}) / sqrt(2{{D}}))"
    y2, inv = f"({y} * {y})", f"(1{{D}} / ({y} * {y}))"
    near = f"(1{{D}} - {y} * {_poly(y2, ERF_P)} / {_poly(y2, (*ERF_Q, 1.0))})"
    middle = f"(exp(-{y2}) * {_poly(y, ERFC_P)} / {_poly(y, (*ERFC_Q, 1.0))})"
    far = f"(exp(-{y2}) / {y} * ({ONE_OVER_SQRT_PI!r}{{D}} - {inv} * {_poly(inv, FAR_P)} / {_poly(inv, (*FAR_Q, 1.0))}))"
    tail = f"(0.5{{D}} * CASE WHEN {y} <= 0.46875{{D}} THEN {near} WHEN {y} <= 4{{D}} THEN {middle} ELSE {far} END)"
    text = f"CASE WHEN {z} > 0 THEN 1{{D}} - {tail} ELSE {tail} END"
    return text.replace("{D}", double) if double else _cast_literals(text)


def _cast_literals(text: str) -> str:
    import re

    return re.sub(r"([0-9.]+(?:e[-+]?[0-9]+)?)\{D\}", r"CAST(\1 AS DOUBLE)", text)


def normal_cdf(z: Column | str) -> Column:
    """Normal distribution function, to about 1e-16; null for null."""
    return _cdf(F.col(z) if isinstance(z, str) else z)


def _horner(x: Column, lowest_first: tuple[float, ...]) -> Column:
    out = F.lit(lowest_first[-1])
    for c in reversed(lowest_first[:-1]):
        out = out * x + F.lit(c)
    return out


def _cdf(z: Column) -> Column:
    y = F.abs(z) / F.sqrt(F.lit(2.0))
    y2 = y * y
    inv = F.lit(1.0) / y2
    near = F.lit(1.0) - y * _horner(y2, ERF_P) / _horner(y2, (*ERF_Q, 1.0))
    middle = F.exp(-y2) * _horner(y, ERFC_P) / _horner(y, (*ERFC_Q, 1.0))
    far = F.exp(-y2) / y * (F.lit(ONE_OVER_SQRT_PI) - inv * _horner(inv, FAR_P) / _horner(inv, (*FAR_Q, 1.0)))
    tail = F.lit(0.5) * F.when(y <= 0.46875, near).when(y <= 4.0, middle).otherwise(far)
    return F.when(z > 0, F.lit(1.0) - tail).otherwise(F.when(z.isNotNull(), tail))


def autoregression(shocks: np.ndarray, phi: float, start: float, block: int = 64) -> np.ndarray:
    """y[i] = phi * y[i-1] + shocks[i] from y[-1] = ``start``: within blocks by the powers of phi, all blocks at once, and then from block to block."""
    n = len(shocks)
    blocks = -(-n // block)
    e = np.zeros(blocks * block)
    e[:n] = shocks
    lags = np.arange(block)[:, None] - np.arange(block)
    powers = np.where(lags >= 0, float(phi) ** np.maximum(lags, 0), 0.0)
    inner = e.reshape(blocks, block) @ powers.T
    out, last = np.empty_like(inner), start
    rise = float(phi) ** np.arange(1, block + 1)
    for k in range(blocks):
        out[k] = inner[k] + rise * last
        last = out[k, -1]
    return out.ravel()[:n]


def day_number(unix_s: Column, reset_hour: int = 0) -> Column:
    """Days since the epoch of times in seconds, a day beginning at ``reset_hour`` UTC."""
    return F.floor((unix_s - F.lit(reset_hour * 3600)) / F.lit(86_400)).cast("long")
