"""Column functions for magnitudes, fluxes, positions, units and labels. NULL stands for missing throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_POINT = 23.9
LOG_CONST = 1 / math.log(10)
SNR_CONST = 1.0857
CLIGHT, H0, OMEGA_M = 299792.458, 70.0, 0.3


def flux(mag: Column, zero: float = ZERO_POINT) -> Column:
    return F.pow(F.lit(10.0), F.lit(-0.4) * (mag - F.lit(zero)))


def logflux(mag: Column) -> Column:
    return F.log10(F.greatest(flux(mag), F.lit(1e-6)))


def flux_error(mag: Column, err: Column) -> Column:
    return err * flux(mag) / F.lit(2.5 * LOG_CONST)


def logflux_error(err: Column) -> Column:
    return err / F.lit(2.5)


def flux_from_log(lf: Column) -> Column:
    return F.pow(F.lit(10.0), lf)


def flux_error_from_log(lf: Column, lfe: Column) -> Column:
    return lfe * flux_from_log(lf) / F.lit(LOG_CONST)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def snr(err: Column) -> Column:
    return F.lit(SNR_CONST) / err


def valid_detection(mag: Column, err: Column, min_snr: float | None = 3.0) -> Column:
    """Both finite, and an error within 1.0857 / min_snr; None leaves the limit out."""
    fine = mag.isNotNull() & ~F.isnan(mag)
    if min_snr is None:
        return fine & err.isNotNull() & ~F.isnan(err)
    return fine & (err > 0) & (err <= F.lit(SNR_CONST / min_snr))  # neither NULL nor NaN lies between


def degrees(value: Column, is_ra: bool) -> Column:
    """hh:mm:ss or +-dd:mm:ss to degrees, the sign taken from the text; plain numbers pass; NULL for anything else."""
    parts = F.split(F.trim(value), ":")
    at = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    whole = F.abs(at(0)) + at(1) / 60 + at(2) / 3600
    signed = F.when(F.trim(value).startswith("-"), -whole).otherwise(whole) * (15 if is_ra else 1)
    return F.when(F.size(parts) == 3, signed).otherwise(F.trim(value).try_cast("double"))


def separation(ra0: Column, dec0: Column, ra: Column, dec: Column) -> Column:
    """Flat-sky arcseconds."""
    return F.lit(3600.0) * F.hypot((ra - ra0) * F.cos(F.radians(dec0)), dec - dec0)


def absolute_magnitude(peak: Column, distance_mpc: Column) -> Column:
    return F.when(distance_mpc > 0, peak - 5 * F.log10(distance_mpc * F.lit(1e5)))


def over(x: Column, err: Column) -> Column:
    """x / err where the error is positive."""
    return F.when(err > 0, x / err)


def null_if(x: Column, *sentinels: float) -> Column:
    return F.when(~x.isin(*sentinels), x)


def phase(span: Column) -> Column:
    """Horizon of the model for a light curve of this length; NULL means the full-curve one."""
    return F.when(span < 7.5, 5).when(span < 15, 10).when(span < 35, 20)


def covering_horizon(age: Column, horizons: tuple[int, ...] = (5, 10, 15, 20, 30)) -> Column:
    out = F.lit(horizons[-1])
    for h in reversed(horizons[:-1]):
        out = F.when(age <= h, h).otherwise(out)
    return out


def finite_or_null(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def truthy(x: Column) -> Column:
    """Lenient boolean of a text; NULL for what is neither."""
    t = F.lower(F.trim(x))
    return F.when(t.isin("1", "true", "yes", "y", "on"), True).when(t.isin("0", "false", "no", "n", "off", ""), False)


def jd_from_date(date: Column, offset: float = 2458000.0) -> Column:
    """Julian date minus offset of a date's first instant."""
    return F.unix_date(date) + F.lit(2440587.5 - offset)
