"""Scalar functions over numbers."""
from pyspark.sql import Column, functions as F


def _c(x):
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def ret(x, base) -> Column:
    """M1. x / base - 1."""
    return _c(x) / F.nullif(_c(base), F.lit(0.0)) - 1


def rebase(high, opening) -> Column:
    """M1. A return measured from another return: (1 + high) / (1 + opening) - 1."""
    return (1 + _c(high)) / F.nullif(1 + _c(opening), F.lit(0.0)) - 1


def continuation(gap, close) -> Column:
    """M3. Close-over-open return taken against the sign of the gap; null for a zero gap."""
    return F.when(_c(gap) != 0, -F.signum(_c(gap)) * rebase(close, gap))


def growth(current, prior) -> Column:
    """M4."""
    return F.when(_c(prior) > 0, _c(current) / F.nullif(_c(prior), F.lit(0.0)) - 1)


def asinh_growth(current, prior) -> Column:
    return F.asinh(growth(current, prior))


def surprise_pct(current, prior) -> Column:
    """M4. Percent change over the absolute prior, four digits; null when the prior is zero."""
    return F.round((_c(current) - _c(prior)) / F.nullif(F.abs(_c(prior)), F.lit(0.0)) * 100, 4)


def surprise_state(current, prior) -> Column:
    return (F.when(_c(current).isNull(), "CURRENT_PERIOD_NOT_YET_KNOWN").when(_c(prior).isNull(), "PRIOR_PERIOD_NOT_FOUND")
            .when(_c(prior) == 0, "PRIOR_PERIOD_ZERO").otherwise("COMPUTED"))


def range_revision(lo, hi, prior_lo, prior_hi) -> Column:
    """M5. Relative move of the midpoint of a guidance range."""
    return (_c(lo) + _c(hi)) / F.nullif(_c(prior_lo) + _c(prior_hi), F.lit(0.0)) - 1


def reaction_gap(expected, opening) -> Column:
    """M6. Percentage points between the expected and the opening return."""
    return 100 * (_c(expected) - _c(opening))


def residual_return(expected, opening) -> Column:
    """M6. What the expected return leaves to happen after the open."""
    return rebase(expected, opening)


def tail_flag(gap, q10, q90, mean, floor=0.02) -> Column:
    """M7. Position against the gap when it lies outside the reference band and far enough from the reference mean."""
    g = _c(gap)
    outside = (g < _c(q10)) | (g > _c(q90))
    return F.when(outside & (F.abs(_c(mean) - g) >= floor), -F.signum(g)).otherwise(0).cast("int")


def magnitude_flag(gap, threshold) -> Column:
    """M7. Position against the gap when its size exceeds the threshold."""
    g = _c(gap)
    return F.when(F.abs(g) > _c(threshold), -F.signum(g)).otherwise(0).cast("int")


def logit(p) -> Column:
    """M8."""
    return F.log(_c(p) / (1 - _c(p)))


def sigmoid(z) -> Column:
    """M8, without overflow on either side."""
    e = F.exp(-F.abs(_c(z)))
    return F.when(_c(z) >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def clip_rate(p, low=0.01, high=0.99) -> Column:
    """M8."""
    return F.least(F.greatest(_c(p), F.lit(low)), F.lit(high))


def rounded(x, digits=10) -> Column:
    """M10. Rounded, and never minus zero."""
    return F.round(_c(x), digits) + F.lit(0.0)


def wilson_low(k, n, z) -> Column:
    return F.greatest(F.lit(0.0), _wilson_centre(k, n, z) - _wilson_half(k, n, z))


def wilson_high(k, n, z) -> Column:
    return F.least(F.lit(1.0), _wilson_centre(k, n, z) + _wilson_half(k, n, z))


def _wilson_centre(k, n, z):
    count = F.nullif(_c(n).cast("double"), F.lit(0.0))
    return (_c(k) / count + z * z / (2 * count)) / (1 + z * z / count)


def _wilson_half(k, n, z):
    count = F.nullif(_c(n).cast("double"), F.lit(0.0))
    p = _c(k) / count
    return z * F.sqrt(p * (1 - p) / count + z * z / (4 * count * count)) / (1 + z * z / count)


def normal_quantile(confidence):
    """A4. The two-sided normal quantile of a confidence level; one literal per confidence."""
    from statistics import NormalDist
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def effective_n(weight) -> Column:
    """A25. Kish effective size of a set of weights, as an aggregate."""
    w = _c(weight)
    return F.coalesce(F.pow(F.sum(w), 2) / F.nullif(F.sum(w * w), F.lit(0.0)), F.lit(0.0))
