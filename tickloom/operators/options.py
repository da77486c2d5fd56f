"""Options: gamma, dealer exposure with its regime, and the variance risk premium at the money."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import ratio

NORMAL = 1 / math.sqrt(2 * math.pi)


def d1(spot: Column, strike: Column, rate: float, sigma: Column, years: float) -> Column:
    return (F.ln(spot / strike) + (rate + sigma * sigma / 2) * years) / (sigma * math.sqrt(years))


def gamma(spot: Column, strike: Column, rate: float, sigma: Column, years: float) -> Column:
    """Black-Scholes gamma; 0 where an input isn't positive."""
    if years <= 0:
        return F.lit(0.0)
    x = d1(spot, strike, rate, sigma, years)
    good = (spot > 0) & (strike > 0) & (sigma > 0)
    return F.when(good, NORMAL * F.exp(-x * x / 2) / (spot * sigma * math.sqrt(years))).otherwise(0.0)


def gamma_exposure(strikes: DataFrame, thresholds: DataFrame, rate: float, years: float, lot: int, chains: DataFrame | None = None) -> DataFrame:
    """chain, gex, low, high, regime (1 above the upper threshold, -1 under the lower, else 0), valid.

    With ``chains`` (chain, spot) every one of these has a row. A chain without strikes or spot, or at its expiry, is invalid: its
    exposure, thresholds and regime are 0.
    """
    side = lambda s: F.sum(F.when(F.col("strike") > 0, F.col(f"oi_{s}") * gamma(F.col("spot"), F.col("strike"), rate, F.col(f"iv_{s}"), years)))
    out = strikes.groupBy("chain").agg(
        (lot * (F.coalesce(side("call"), F.lit(0.0)) - F.coalesce(side("put"), F.lit(0.0)))).alias("gex"), F.max("spot").alias("_spot")
    )
    if chains is not None:
        out = chains.select("chain").distinct().join(out, "chain", "left")
    good = F.coalesce(F.col("_spot") > 0, F.lit(False)) & F.lit(years > 0)
    zero = lambda c: F.when(F.col("valid"), c).otherwise(0.0)
    out = out.join(thresholds, "chain", "left").withColumn("valid", good).withColumns({"gex": zero(F.col("gex")), "low": zero(F.col("low")), "high": zero(F.col("high"))})
    regime = F.when(F.col("valid") & (F.col("gex") > F.col("high")), 1).when(F.col("valid") & (F.col("gex") < F.col("low")), -1).otherwise(0)
    return out.drop("_spot").withColumn("regime", regime)


def exposure_profile(strikes: DataFrame, single: Column, rate: float, years: float, lot: int, chains: DataFrame | None = None) -> DataFrame:
    """As ``gamma_exposure`` with the thresholds of ``single``, the exposure of each strike: all in one aggregation by chain.

    ``chains`` (chain) may be named that have no strikes.
    """
    both, n = F.percentile(single, F.array(F.lit(0.05), F.lit(0.95))), F.count(single)
    side = lambda s: F.coalesce(F.sum(F.when(F.col("strike") > 0, F.col(f"oi_{s}") * gamma(F.col("spot"), F.col("strike"), rate, F.col(f"iv_{s}"), years))), F.lit(0.0))
    out = strikes.groupBy("chain").agg(
        (lot * (side("call") - side("put"))).alias("gex"), F.max("spot").alias("_spot"),
        F.when(n >= 2, both[0]).otherwise(-1e6).alias("low"), F.when(n >= 2, both[1]).otherwise(1e6).alias("high"),
    )
    if chains is not None:
        out = out.join(chains.select("chain").distinct(), "chain", "full")
    good = F.coalesce(F.col("_spot") > 0, F.lit(False)) & F.lit(years > 0)
    zero = lambda c: F.when(good, F.col(c)).otherwise(0.0)
    out = out.select("chain", *[zero(c).alias(c) for c in ("gex", "low", "high")], good.alias("valid"))
    regime = F.when(F.col("valid") & (F.col("gex") > F.col("high")), 1).when(F.col("valid") & (F.col("gex") < F.col("low")), -1).otherwise(0)
    return out.withColumn("regime", regime)


def at_the_money(strikes: DataFrame) -> DataFrame:
    """The strike nearest to the spot of each chain, the first in order on a tie."""
    rank = F.struct(F.abs(F.col("strike") - F.col("spot")), "ord")
    row = F.struct("ord", "spot", "strike", "iv_call", "iv_put")
    return strikes.where("strike > 0").groupBy("chain").agg(F.min_by(row, rank).alias("r")).select("chain", "r.*")


def variance_premium(atm: DataFrame, annual_variance: Column) -> DataFrame:
    """atm_iv (the mean, or the positive side), vrp = iv^2 - variance, and that over the variance."""
    c, p = F.col("iv_call"), F.col("iv_put")
    iv = F.when((c > 0) & (p > 0), (c + p) / 2).when(c > 0, c).when(p > 0, p)
    return (
        atm.withColumn("atm_iv", F.coalesce(iv, F.lit(0.0))).withColumn("vrp_valid", iv.isNotNull())
        .withColumn("vrp", F.when(iv.isNotNull(), iv * iv - annual_variance).otherwise(0.0))
        .withColumn("vrp_norm", ratio(F.col("vrp"), annual_variance))
    )
