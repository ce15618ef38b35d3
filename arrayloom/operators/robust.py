"""Normalisation of values that is robust against outliers: fences are fitted by quantiles, then applied as an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.functions.elementwise import clip, divide

#: Fixed: the width over which a sigmoid runs from 0.5 % to 99.5 % is 2 * 6.212606 times its scale.
SPREAD = 6.212606095751518
PRESETS = {
    "tukey": {"extrema": "tukey", "scaling": "linear"},
    "iqr": {"extrema": "tukey", "scaling": "linear"},
    "linear": {"extrema": "custom-quantile", "scaling": "linear", "low": 0.01, "mid": 0.5, "high": 0.9},
    "sigmoid": {"extrema": "custom-quantile", "scaling": "sigmoid", "low": 0.01, "mid": 0.5, "high": 0.9},
}
PRESETS["auto"] = PRESETS["linear"]


def _parameters(params: str | dict) -> dict:
    if isinstance(params, str):
        if params not in PRESETS:
            raise KeyError(params)
        return PRESETS[params]
    return PRESETS["auto"] | params


def tukey_fence(q1: Column, q3: Column, textbook: bool = False) -> tuple[Column, Column]:
    """One and a half interquartile ranges below and above the first quartile; textbook: above the third one."""
    reach = F.lit(1.5) * (q3 - q1)
    return q1 - reach, (q3 if textbook else q1) + reach


def quantile_fence(low: Column, mid: Column, high: Column) -> tuple[Column, Column, Column]:
    return low, mid, high


def adaptive_fence(q0: Column, low: Column, mid: Column, q1: Column, low_share: float) -> tuple[Column, Column]:
    """Reach below the low quantile in proportion to its distance from the middle, not below the data; above, to the greatest value."""
    return F.greatest(q0, low - F.lit(float(low_share)) * (mid - low)), q1


def find_robust_normalizers(df: DataFrame, value: str, params: str | dict = "auto", by: list[str] | None = None, textbook: bool = False) -> DataFrame:
    """A row for each `by` group: min_val, mid_val, max_val, beta, alpha. NULL without data.

    params: a preset, or a dict with extrema (tukey, tukey-clip, quantile, custom-quantile), scaling (linear, sigmoid)
    and the shares low, mid, high.
    """
    p = _parameters(params)
    by = by or []
    x = F.col(value).cast("double")
    shares = (0.0, 0.25, 0.5, 0.75, 1.0) if p["extrema"].startswith(("tukey", "iqr")) else (0.0, p["low"], p["mid"], p["high"], 1.0)
    q = df.groupBy(*by).agg(F.percentile(x, F.array(*[F.lit(float(s)) for s in shares])).alias("q"))
    q0, a, m, b, q1 = (F.col("q")[i] for i in range(5))
    if p["extrema"].startswith(("tukey", "iqr")):
        low, high = tukey_fence(a, b, textbook)
        if p["extrema"].endswith("-clip"):
            low, high = F.greatest(low, q0), F.least(high, q1)
    elif p["extrema"] == "quantile":
        low, _, high = quantile_fence(a, m, b)
    elif p["extrema"] not in ("custom-quantile", "adaptive-quantile"):
        raise KeyError(p["extrema"])
    else:
        low, high = adaptive_fence(q0, a, m, q1, p["low"])
    out = q.select(*by, low.alias("min_val"), m.alias("mid_val"), high.alias("max_val"), m.alias("beta"))
    return out.withColumn("alpha", F.greatest(F.abs(F.col("min_val") - F.col("beta")), F.abs(F.col("max_val") - F.col("beta"))) / F.lit(SPREAD))


def normalized(x: Column, mode: str, low: Column, high: Column, alpha: Column | None = None, beta: Column | None = None, top: float = 1.0) -> Column:
    """Values clamped to low and high, then scaled to 0 to top: linear, or by a sigmoid of centre beta and scale alpha.

    Without a span, linear scaling has a factor of 1. beta defaults to the span, alpha to the farther end's distance
    from beta over SPREAD; an alpha near 0 is 1.
    """
    x = clip(x.cast("double"), low, high)
    span = high - low
    if mode == "linear":
        return (x - low) * F.when(span == 0, F.lit(1.0)).otherwise(F.lit(float(top)) / F.when(span != 0, span))
    if mode != "sigmoid":
        raise KeyError(mode)
    beta = span if beta is None else beta
    alpha = F.greatest(F.abs(low - beta), F.abs(high - beta)) / F.lit(SPREAD) if alpha is None else alpha
    alpha = F.when(F.abs(alpha) < 1e-8, F.lit(1.0)).otherwise(alpha)
    return F.lit(float(top)) / (1 + F.exp(-divide(x - beta, alpha)))


def normalize(df: DataFrame, value: str, mode: str = "linear", out: str = "normalized", by: list[str] | None = None, top: float = 1.0, whole: str | None = None, alpha: float | None = None, beta: float | None = None, min_val: float | None = None, max_val: float | None = None) -> DataFrame:
    """df with a column of values scaled by their own extremes (NaN left out), or by those given. whole: an integer type to cut to.

    alpha and beta: scale and centre of the sigmoid, by default as `normalized` has them.
    """
    by = by or []
    x = F.col(value).cast("double")
    seen = F.when(~F.isnan(x), x)
    ends = df.groupBy(*by).agg(F.min(seen).alias("_low"), F.max(seen).alias("_high"))
    joined = df.join(ends, by) if by else df.join(F.broadcast(ends))  # without groups, one row
    given = lambda c: None if c is None else F.lit(float(c))
    low, high = (F.col(c) if g is None else F.lit(float(g)) for c, g in (("_low", min_val), ("_high", max_val)))
    scaled = normalized(x, mode, low, high, given(alpha), given(beta), top=top)
    return joined.withColumn(out, scaled.cast(whole) if whole else scaled).drop("_low", "_high")


def robust_normalize(df: DataFrame, value: str, params: str | dict = "auto", out: str = "normalized", by: list[str] | None = None, valid: Column | None = None, nodata: float | None = None) -> DataFrame:
    """df with a column of values scaled by fences that are fitted on valid values; invalid ones stay as they are.

    Valid: what the mask says; else not NaN and not the nodata value. Each `by` group has its own fences.
    """
    by = by or []
    x = F.col(value).cast("double")
    if valid is None:
        valid = ~F.isnan(x) & ((x != nodata) if nodata is not None else F.lit(True))
    p = _parameters(params)
    marked = df.withColumn("_valid", valid)
    fitted = find_robust_normalizers(marked.where("_valid"), value, params, by)
    joined = marked.join(fitted, by, "left") if by else marked.join(F.broadcast(fitted))  # one row
    scaled = normalized(x, p["scaling"], F.col("min_val"), F.col("max_val"), F.col("alpha"), F.col("beta"))
    return joined.withColumn(out, F.when(F.col("_valid"), scaled).otherwise(x)).drop("_valid", "min_val", "mid_val", "max_val", "beta", "alpha")


__all__ = ["adaptive_fence", "find_robust_normalizers", "normalize", "normalized", "quantile_fence", "robust_normalize", "tukey_fence"]
