"""Registered queries: option desk, large trades, evaluation, books, indicators and further streams."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import pricing
from ..operators import options as O, ranks, trends, windows as R
from ..sources import tables as T
from ..streaming import live
from . import catalog
from .catalog import _FIFO, _FILLS, BARS, CHAIN, CLOSES, OVER, TICKS, _priced, books, hourly, query
from .markets import _COMBINED, _DAILY, combined, daily
from .more import folder

BY = ["underlying", "month"]


def N(x: str) -> str:
    """The distribution function of ``pricing.cdf`` in SQL."""
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    tail = f"(exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


_YEAR = "(30 / 365.0::DOUBLE)"
_MODEL = f"SELECT *, d1 - sigma * sqrt({_YEAR}) AS d2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS density FROM (SELECT *, (ln(spot / strike) + sigma * sigma / 2 * {_YEAR}) / (sigma * sqrt({_YEAR})) AS d1 FROM (SELECT *, 0.1::DOUBLE + (month % 7) / 20 AS sigma FROM {CHAIN}))"
_GREEKS = f"SELECT *, CASE WHEN option_type = 'CE' THEN {N('d1')} ELSE {N('d1')} - 1 END AS delta, density / (spot * sigma * sqrt({_YEAR})) AS gamma, -(spot * density * sigma) / (2 * sqrt({_YEAR})) / 365 AS theta, spot * density * sqrt({_YEAR}) / 100 AS vega FROM ({_MODEL})"
catalog.SQL["option_greeks"] = f"SELECT underlying, month, strike, option_type, round(delta, 8) AS delta, round(gamma, 8) AS gamma, round(theta, 8) AS theta, round(vega, 8) AS vega FROM ({_GREEKS})"
_GEX = f"SELECT *, gamma * oi * spot * spot * 0.01 * CASE WHEN option_type = 'CE' THEN 1 ELSE -1 END AS gex FROM ({_GREEKS})"
_WALK = f"SELECT underlying, month, strike, gex, sum(gex) OVER (PARTITION BY underlying, month ORDER BY strike) AS total FROM (SELECT underlying, month, strike, sum(gex) AS gex FROM ({_GEX}) GROUP BY 1, 2, 3)"
catalog.SQL["gamma_flip"] = f"SELECT underlying, month, round(arg_min(below + (strike - below) * before / (before - total), CASE WHEN before * total < 0 THEN strike END), 6) AS flip, round(sum(gex), 4) AS net_gex FROM (SELECT *, lag(total) OVER w AS before, lag(strike) OVER w AS below FROM ({_WALK}) WINDOW w AS (PARTITION BY underlying, month ORDER BY strike)) GROUP BY 1, 2"


def greeks_of(spark, sf_dir):
    c = _priced(spark, sf_dir)
    return c.withColumns(pricing.greeks(O.is_call(), F.col("spot"), F.col("strike"), F.col("t"), F.col("r"), F.col("sigma")))


# Options (I).

@query(f"SELECT underlying, month, strike, option_type, round(CASE WHEN option_type = 'CE' THEN spot * {N('d1')} - strike * {N('d2')} ELSE strike * {N('(-d2)')} - spot * {N('(-d1)')} END, 6) AS price FROM ({_MODEL})")
def futures_option_price(spark, sf_dir):
    """The undiscounted forward form."""
    c = _priced(spark, sf_dir)
    return c.select(*BY, "strike", "option_type", F.round(pricing.black_scholes(O.is_call(), F.col("spot"), F.col("strike"), F.col("t"), F.lit(0.0), F.col("sigma")), 6).alias("price"))


@query(f"SELECT underlying, month, strike, option_type, CASE WHEN oi > 20 THEN round(delta, 6) WHEN option_type = 'CE' THEN CASE WHEN spot > strike THEN 1 ELSE 0 END ELSE CASE WHEN spot < strike THEN -1 ELSE 0 END END::DOUBLE AS delta, CASE WHEN oi > 20 THEN 'model' ELSE 'intrinsic' END AS source FROM ({_GREEKS})")
def delta_with_fallback(spark, sf_dir):
    """The model's delta where the contract is held enough to trust its price, else 0 or one by moneyness."""
    inside = F.when(O.is_call(), F.when(F.expr("spot > strike"), 1).otherwise(0)).otherwise(F.when(F.expr("spot < strike"), -1).otherwise(0)).cast("double")
    good = F.col("oi") > 20
    return greeks_of(spark, sf_dir).select(*BY, "strike", "option_type", F.when(good, F.round("delta", 6)).otherwise(inside).alias("delta"), F.when(good, "model").otherwise("intrinsic").alias("source"))


@query(f"SELECT underlying, month, strike, option_type, flags, CASE WHEN flags LIKE '%below intrinsic%' THEN 'unusable' WHEN flags != '' THEN 'weak' ELSE 'good' END AS grade FROM (SELECT *, concat_ws(',', CASE WHEN premium < greatest(0, CASE WHEN option_type = 'CE' THEN spot - strike ELSE strike - spot END) THEN 'below intrinsic' END, CASE WHEN oi < 20 THEN 'thin' END, CASE WHEN abs(strike / spot - 1) > 0.3 THEN 'far' END) AS flags FROM {CHAIN})")
def volatility_gate(spark, sf_dir):
    intrinsic = F.greatest(F.lit(0.0), F.when(O.is_call(), F.expr("spot - strike")).otherwise(F.expr("strike - spot")))
    flags = F.concat_ws(",", F.when(F.col("premium") < intrinsic, "below intrinsic"), F.when(F.col("oi") < 20, "thin"), F.when(F.abs(F.col("strike") / F.col("spot") - 1) > 0.3, "far"))
    grade = F.when(F.col("flags").contains("below intrinsic"), "unusable").when(F.col("flags") != "", "weak").otherwise("good")
    return T.chain(spark, sf_dir).withColumn("flags", flags).select(*BY, "strike", "option_type", "flags", grade.alias("grade"))


_GRID = f"SELECT underlying, month, step, sum(density / (spot * (1 + step / 100.0::DOUBLE) * sigma * sqrt({_YEAR})) * oi * CASE WHEN option_type = 'CE' THEN 1 ELSE -1 END) AS net FROM (SELECT *, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS density FROM (SELECT *, (ln(spot * (1 + step / 100.0::DOUBLE) / strike) + sigma * sigma / 2 * {_YEAR}) / (sigma * sqrt({_YEAR})) AS d1 FROM (SELECT *, 0.1::DOUBLE + (month % 7) / 20 AS sigma FROM {CHAIN}) CROSS JOIN (SELECT unnest(range(-5, 6)) AS step))) GROUP BY 1, 2, 3"


@query(f"SELECT underlying, month, arg_min(step, abs(step) * 100 + step) AS nearest FROM (SELECT *, lag(net) OVER (PARTITION BY underlying, month ORDER BY step) AS before FROM ({_GRID})) WHERE before * net < 0 GROUP BY 1, 2")
def zero_gamma_grid(spark, sf_dir):
    """The step of a spot grid of five per cent either way, nearest the spot, at which net gamma changes sign."""
    c = _priced(spark, sf_dir).withColumn("step", F.explode(F.sequence(F.lit(-5), F.lit(5))))
    spot = F.col("spot") * (1 + F.col("step") / 100)
    gamma = pricing.greeks(O.is_call(), spot, F.col("strike"), F.col("t"), F.col("r"), F.col("sigma"))["gamma"]
    g = c.groupBy(*BY, "step").agg(F.sum(gamma * F.col("oi") * F.when(O.is_call(), 1).otherwise(-1)).alias("net"))
    g = g.withColumn("before", F.lag("net").over(W.partitionBy(*BY).orderBy("step"))).where("before * net < 0")
    return g.groupBy(*BY).agg(F.min_by("step", F.abs("step") * 100 + F.col("step")).cast("long").alias("nearest"))


_NET = f"SELECT underlying, month, sum(gex) AS net FROM ({_GEX}) GROUP BY 1, 2"


@query(f"WITH n AS ({_NET}), p AS (SELECT a.underlying, a.month, count(b.month) AS held, avg(CASE WHEN round(b.net, 6) <= round(a.net, 6) THEN 1.0 ELSE 0.0 END) AS share FROM n a JOIN n b ON a.underlying = b.underlying AND b.month BETWEEN a.month - 11 AND a.month GROUP BY 1, 2) SELECT underlying, month, CASE WHEN held < 5 THEN NULL WHEN share <= 0.2 THEN 'very low' WHEN share <= 0.4 THEN 'low' WHEN share <= 0.6 THEN 'middle' WHEN share <= 0.8 THEN 'high' ELSE 'very high' END AS regime FROM p")
def exposure_regimes(spark, sf_dir):
    """Net exposure by its place among the last twelve months, from five on."""
    e = greeks_of(spark, sf_dir).withColumn("gex", pricing.gamma_exposure(O.is_call(), F.col("gamma"), F.col("oi"), F.col("spot")))
    n = e.groupBy(*BY).agg(F.round(F.sum("gex"), 6).alias("net"))
    n = n.withColumn("held", F.collect_list("net").over(W.partitionBy("underlying").orderBy("month").rangeBetween(-11, 0)))  # twelve values at most
    share = F.size(F.filter("held", lambda v: v <= F.col("net"))) / F.size("held")
    return n.withColumn("share", share).select(*BY, F.when(F.size("held") < 5, F.lit(None)).when(F.col("share") <= 0.2, "very low").when(F.col("share") <= 0.4, "low").when(F.col("share") <= 0.6, "middle").when(F.col("share") <= 0.8, "high").otherwise("very high").alias("regime"))


@query(f"SELECT underlying, month, arg_max(strike, struct_pack(g := round(gex, 6), s := -strike)) FILTER (WHERE option_type = 'CE') AS call_wall, arg_min(strike, struct_pack(g := round(gex, 6), s := strike)) FILTER (WHERE option_type = 'PE') AS put_wall FROM ({_GEX}) GROUP BY 1, 2")
def exposure_walls(spark, sf_dir):
    e = greeks_of(spark, sf_dir).withColumn("gex", F.round(pricing.gamma_exposure(O.is_call(), F.col("gamma"), F.col("oi"), F.col("spot")), 6))
    call, put = F.struct("gex", -F.col("strike")), F.struct("gex", F.col("strike"))
    return e.groupBy(*BY).agg(F.max_by("strike", F.when(O.is_call(), call)).alias("call_wall"), F.min_by("strike", F.when(~O.is_call(), put)).alias("put_wall"))


@query(f"SELECT underlying, month, option_type, strike, grown, place, round(sum(grown) OVER (PARTITION BY underlying, option_type, strike ORDER BY month), 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY underlying, month, option_type ORDER BY grown DESC, strike) AS place FROM (SELECT underlying, month, option_type, strike, greatest(0, oi - coalesce(lag(oi) OVER (PARTITION BY underlying, option_type, strike ORDER BY month), oi)) AS grown FROM {CHAIN})) WHERE place <= 5")
def volume_spectrum(spark, sf_dir):
    """The five strikes of each side whose count grew most, and their running sums."""
    one = W.partitionBy("underlying", "option_type", "strike").orderBy("month")
    c = T.chain(spark, sf_dir).withColumn("grown", F.greatest(F.lit(0.0), F.col("oi") - F.coalesce(F.lag("oi").over(one), F.col("oi"))))
    c = c.withColumn("place", F.row_number().over(W.partitionBy(*BY, "option_type").orderBy(F.desc("grown"), "strike")).cast("long")).where("place <= 5")
    return c.select(*BY, "option_type", "strike", "grown", "place", F.round(F.sum("grown").over(one), 6).alias("total"))


@query(f"SELECT underlying, month, round(sum(premium * oi) FILTER (WHERE option_type = 'PE') / nullif(sum(premium * oi) FILTER (WHERE option_type = 'CE'), 0), 6) AS premium_pcr, round(avg(premium / spot) FILTER (WHERE abs(strike / spot - 1) <= 0.05), 6) AS at_share, round(avg(premium - greatest(0, CASE WHEN option_type = 'CE' THEN spot - strike ELSE strike - spot END)), 6) AS extrinsic FROM {CHAIN} GROUP BY 1, 2")
def premium_ratios(spark, sf_dir):
    turnover = F.col("premium") * F.col("oi")
    side = lambda k: F.sum(F.when(F.col("option_type") == k, turnover))
    intrinsic = F.greatest(F.lit(0.0), F.when(O.is_call(), F.expr("spot - strike")).otherwise(F.expr("strike - spot")))
    return T.chain(spark, sf_dir).groupBy(*BY).agg(F.round(side("PE") / F.nullif(side("CE"), F.lit(0.0)), 6).alias("premium_pcr"), F.round(F.avg(F.when(F.abs(F.col("strike") / F.col("spot") - 1) <= 0.05, F.col("premium") / F.col("spot"))), 6).alias("at_share"), F.round(F.avg(F.col("premium") - intrinsic), 6).alias("extrinsic"))


@query(f"SELECT underlying, month, strike, rung - max(CASE WHEN near THEN rung END) OVER (PARTITION BY underlying, month) AS rung, oi FROM (SELECT *, row_number() OVER (PARTITION BY underlying, month ORDER BY strike) AS rung, row_number() OVER (PARTITION BY underlying, month ORDER BY abs(strike - spot), oi DESC, strike) = 1 AS near FROM (SELECT underlying, month, strike, sum(oi) AS oi, max(spot) AS spot FROM {CHAIN} GROUP BY 1, 2, 3))")
def strike_ladder(spark, sf_dir):
    """Strikes by the number of rungs from the one at the money."""
    s = T.chain(spark, sf_dir).groupBy(*BY, "strike").agg(F.sum("oi").alias("oi"), F.max("spot").alias("spot"))
    s = s.withColumns({"n": F.row_number().over(W.partitionBy(*BY).orderBy("strike")).cast("long"), "near": F.row_number().over(W.partitionBy(*BY).orderBy(F.abs(F.col("strike") - F.col("spot")), F.desc("oi"), "strike"))})
    return s.select(*BY, "strike", (F.col("n") - F.max(F.when(F.col("near") == 1, F.col("n"))).over(W.partitionBy(*BY))).alias("rung"), "oi")


@query(f"SELECT underlying, month, CASE WHEN same AND doi > 0 AND dp > 0 THEN 'long build-up' WHEN same AND doi > 0 AND dp < 0 THEN 'short build-up' WHEN same AND doi < 0 AND dp > 0 THEN 'short covering' WHEN same AND doi < 0 AND dp < 0 THEN 'long unwinding' END AS state FROM (SELECT underlying, month, oi - lag(oi) OVER w AS doi, round(p - lag(p) OVER w, 9) AS dp, (month // 3) = lag(month // 3) OVER w AS same FROM (SELECT underlying, month, sum(oi) AS oi, avg(premium) AS p FROM {CHAIN} GROUP BY 1, 2) WINDOW w AS (PARTITION BY underlying ORDER BY month))")
def guarded_interest_state(spark, sf_dir):
    """The state of open interest, only where the contract in front is the one of the row before."""
    w = W.partitionBy("underlying").orderBy("month")
    s = T.chain(spark, sf_dir).groupBy(*BY).agg(F.sum("oi").alias("oi"), F.avg("premium").alias("p"))
    s = s.withColumns({"doi": F.col("oi") - F.lag("oi").over(w), "dp": F.round(F.col("p") - F.lag("p").over(w), 9), "same": F.expr("month div 3") == F.lag(F.expr("month div 3")).over(w)})
    state = F.when(F.expr("doi > 0 and dp > 0"), "long build-up").when(F.expr("doi > 0 and dp < 0"), "short build-up").when(F.expr("doi < 0 and dp > 0"), "short covering").when(F.expr("doi < 0 and dp < 0"), "long unwinding")
    return s.select(*BY, F.when(F.col("same"), state).alias("state"))


@query(f"WITH c AS (SELECT *, month % 3 AS series FROM {CHAIN}), f AS (SELECT underlying, month // 12 AS year, min(series) AS front FROM c GROUP BY 1, 2), l AS (SELECT c.underlying, month // 12 AS year, strike, option_type, arg_max(oi, month) AS oi, arg_max(premium, month) AS premium FROM c JOIN f ON f.underlying = c.underlying AND f.year = c.month // 12 AND f.front = c.series GROUP BY 1, 2, 3, 4) SELECT underlying, year, round(sum(oi) FILTER (WHERE option_type = 'CE'), 4) AS call_oi, round(sum(oi) FILTER (WHERE option_type = 'PE'), 4) AS put_oi, round(sum(oi * premium) / nullif(sum(oi), 0), 6) AS weighted FROM l GROUP BY 1, 2")
def front_interest(spark, sf_dir):
    """Of the series in front, each contract's last row, summed by side and weighted by interest."""
    c = T.chain(spark, sf_dir).withColumns({"series": F.col("month") % 3, "year": F.expr("month div 12")})
    front = c.groupBy("underlying", "year").agg(F.min("series").alias("series"))
    last = c.join(F.broadcast(front), ["underlying", "year", "series"]).groupBy("underlying", "year", "strike", "option_type").agg(F.max_by("oi", "month").alias("oi"), F.max_by("premium", "month").alias("premium"))
    side = lambda k: F.round(F.sum(F.when(F.col("option_type") == k, F.col("oi"))), 4)
    return last.groupBy("underlying", "year").agg(side("CE").alias("call_oi"), side("PE").alias("put_oi"), F.round(F.sum(F.col("oi") * F.col("premium")) / F.nullif(F.sum("oi"), F.lit(0.0)), 6).alias("weighted"))


@query(f"SELECT underlying, option_type, round(sum(delta * oi * spot), 2) AS delta_value, round(sum(theta * oi), 4) AS theta, round(sum(vega * oi), 4) AS vega FROM ({_GREEKS}) GROUP BY 1, 2 ORDER BY abs(round(sum(delta * oi * spot), 2)) DESC, 1, 2 LIMIT 8")
def book_greeks(spark, sf_dir):
    """Greeks of a book by underlying and side, the eight largest by delta."""
    s = greeks_of(spark, sf_dir).groupBy("underlying", "option_type").agg(F.round(F.sum(F.expr("delta * oi * spot")), 2).alias("delta_value"), F.round(F.sum(F.expr("theta * oi")), 4).alias("theta"), F.round(F.sum(F.expr("vega * oi")), 4).alias("vega"))
    return s.orderBy(F.desc(F.abs("delta_value")), "underlying", "option_type").limit(8)


@query(f"SELECT underlying, month, left_, round(sum(CASE WHEN option_type = 'CE' AND spot > strike OR option_type = 'PE' AND spot < strike THEN oi * strike ELSE 0 END) * CASE WHEN left_ = 0 THEN 1.0 WHEN left_ = 1 THEN 0.75 WHEN left_ = 2 THEN 0.5 WHEN left_ = 3 THEN 0.25 ELSE 0.0 END, 2) AS margin FROM (SELECT *, month % 6 AS left_ FROM {CHAIN}) GROUP BY 1, 2, 3")
def settlement_exposure(spark, sf_dir):
    """What contracts in the money would have to be settled for, by stages of the last sessions."""
    inside = F.expr("option_type = 'CE' and spot > strike or option_type = 'PE' and spot < strike")
    left = F.col("month") % 6
    stage = F.when(F.col("left_") == 0, 1.0).when(F.col("left_") == 1, 0.75).when(F.col("left_") == 2, 0.5).when(F.col("left_") == 3, 0.25).otherwise(0.0)
    s = T.chain(spark, sf_dir).withColumn("left_", left).groupBy(*BY, "left_").agg(F.sum(F.when(inside, F.col("oi") * F.col("strike")).otherwise(0.0)).alias("due"))
    return s.select(*BY, "left_", F.round(F.col("due") * stage, 2).alias("margin"))


_MOVES = "SELECT unnest([0, 1/3.0, -1/3.0, 2/3.0, -2/3.0, 1, -1, 2, -2]::DOUBLE[]) AS move"


@query(f"SELECT underlying, month, round(greatest(max(loss), 0.02 * max(notional)), 2) AS margin FROM (SELECT underlying, month, move, sum(oi * greatest(0, CASE WHEN option_type = 'CE' THEN spot * (1 + 0.1 * move) - strike ELSE strike - spot * (1 + 0.1 * move) END) - oi * premium) * CASE WHEN abs(move) > 1 THEN 0.35 ELSE 1 END AS loss, sum(oi * spot) AS notional FROM {CHAIN} CROSS JOIN ({_MOVES}) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def scan_margin(spark, sf_dir):
    """A short book's worst loss over moves of the scan range and twice it at a cover fraction, with a least charge."""
    moves = F.array(*[F.lit(float(m)) for m in (0, 1 / 3, -1 / 3, 2 / 3, -2 / 3, 1, -1, 2, -2)])
    c = T.chain(spark, sf_dir).withColumn("move", F.explode(moves))
    at = F.col("spot") * (1 + 0.1 * F.col("move"))
    owed = F.greatest(F.lit(0.0), F.when(O.is_call(), at - F.col("strike")).otherwise(F.col("strike") - at))
    loss = F.sum(F.col("oi") * owed - F.col("oi") * F.col("premium")) * F.when(F.abs("move") > 1, 0.35).otherwise(1.0)
    s = c.groupBy(*BY, "move").agg(loss.alias("loss"), F.sum(F.col("oi") * F.col("spot")).alias("notional"))
    return s.groupBy(*BY).agg(F.round(F.greatest(F.max("loss"), 0.02 * F.max("notional")), 2).alias("margin"))


@query(f"SELECT underlying, month, strike, option_type, round(theta / nullif(premium, 0), 8) AS theta_share, round(ln(strike / spot), 8) AS log_moneyness, round((30 * 86400 + 55800 - month % 86400) / (365.0 * 86400), 10) AS years FROM ({_GREEKS})")
def theta_share(spark, sf_dir):
    """Decay as a share of the premium, log moneyness and the fraction of a year until the close of the last day."""
    return greeks_of(spark, sf_dir).select(*BY, "strike", "option_type", F.round(F.col("theta") / F.nullif(F.col("premium"), F.lit(0.0)), 8).alias("theta_share"), F.round(F.log(F.col("strike") / F.col("spot")), 8).alias("log_moneyness"), F.round((30 * 86_400 + 55_800 - F.col("month") % 86_400) / (365.0 * 86_400), 10).alias("years"))


# Large trades (H).

@query(f"SELECT symbol, seq, hits FROM (SELECT symbol, seq, count(*) OVER (PARTITION BY symbol, side ORDER BY ts_s RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS hits FROM ({_COMBINED}) WHERE size = 50 AND side != 0) WHERE hits >= 2")
def sliced_orders(spark, sf_dir):
    """Prints of exactly the most that one order may hold, repeated on one side within six hours."""
    w = W.partitionBy("symbol", "side").orderBy("ts_s").rangeBetween(-21_600, 0)
    return combined(spark, sf_dir).where("size = 50 and side != 0").withColumn("hits", F.count(F.lit(1)).over(w)).where("hits >= 2").select("symbol", "seq", "hits")


@query(f"SELECT symbol, size, n, round(cv, 5) AS cv FROM (SELECT symbol, size, count(*) AS n, stddev_pop(gap) / nullif(avg(gap), 0) AS cv FROM (SELECT symbol, size, ts_s - lag(ts_s) OVER (PARTITION BY symbol, size ORDER BY seq) AS gap FROM {TICKS}) WHERE gap IS NOT NULL GROUP BY 1, 2) WHERE n >= 4 AND cv <= 0.9")
def constant_children(spark, sf_dir):
    """Sizes of a symbol that come again and again at even intervals."""
    w = W.partitionBy("symbol", "size").orderBy("seq")
    g = T.ticks(spark, sf_dir).withColumn("gap", F.col("ts_s") - F.lag("ts_s").over(w)).where("gap is not null")
    s = g.groupBy("symbol", "size").agg(F.count(F.lit(1)).alias("n"), (F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0))).alias("cv"))
    return s.where("n >= 4 and cv <= 0.9").select("symbol", "size", "n", F.round("cv", 5).alias("cv"))


@query(f"SELECT underlying, month, round(sum(delta * doi * spot), 2) AS net_delta, count(*) FILTER (WHERE abs(doi) > 30) AS unusual FROM (SELECT *, oi - lag(oi) OVER (PARTITION BY underlying, strike, option_type ORDER BY month) AS doi FROM ({_GREEKS})) WHERE doi IS NOT NULL GROUP BY 1, 2")
def strike_window_delta(spark, sf_dir):
    """The signed delta that the change of interest between snapshots stands for, and how many changes stand out."""
    w = W.partitionBy("underlying", "strike", "option_type").orderBy("month")
    g = greeks_of(spark, sf_dir).withColumn("doi", F.col("oi") - F.lag("oi").over(w)).where("doi is not null")
    return g.groupBy(*BY).agg(F.round(F.sum(F.expr("delta * doi * spot")), 2).alias("net_delta"), F.count_if(F.abs("doi") > 30).alias("unusual"))


@query(f"SELECT symbol, day, round((coalesce(2 * a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif(CASE WHEN a IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN b IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN c IS NOT NULL THEN 1 ELSE 0 END, 0), 5) AS z FROM (SELECT symbol, day, (volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0) AS a, (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) AS b, CASE WHEN day % 3 != 0 THEN (high - low - avg(high - low) OVER w) / nullif(stddev_samp(high - low) OVER w, 0) END AS c FROM ({_DAILY}) WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))")
def composite_z(spark, sf_dir):
    """A weighted mean of three z values, those that are missing left out of the weights."""
    w = W.partitionBy("symbol").orderBy("day").rowsBetween(-10, -1)
    z = lambda x: (x - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))
    d = daily(spark, sf_dir).select("symbol", "day", z(F.col("volume")).alias("a"), z(F.col("close")).alias("b"), F.when(F.col("day") % 3 != 0, z(F.col("high") - F.col("low"))).alias("c"))
    weight = {"a": 2, "b": 1, "c": 1}
    total = sum(F.coalesce(k * F.col(c), F.lit(0.0)) for c, k in weight.items())
    held = sum(F.when(F.col(c).isNotNull(), k).otherwise(0) for c, k in weight.items())
    return d.select("symbol", "day", F.round(total / F.nullif(held, F.lit(0)), 5).alias("z"))


@query(f"SELECT symbol, events, largest, CASE WHEN bought > 1.5 * sold THEN 'buy' WHEN sold > 1.5 * bought THEN 'sell' ELSE 'mixed' END AS side, round(share, 6) AS share, round(largest / 50.0 + 0.3 * ln(1 + greatest(events - 1, 0)), 6) AS score FROM (SELECT symbol, count(*) FILTER (WHERE size >= 45) AS events, max(size) AS largest, sum(size) FILTER (WHERE size >= 45 AND side > 0) AS bought, sum(size) FILTER (WHERE size >= 45 AND side < 0) AS sold, sum(size) FILTER (WHERE size >= 45) / sum(size) AS share FROM ({_COMBINED}) GROUP BY 1) ORDER BY score DESC, symbol LIMIT 20")
def name_list(spark, sf_dir):
    """Names by their large prints: number, largest, side, share of volume and a score of these."""
    big = F.col("size") >= 45
    of = lambda c: F.sum(F.when(c, F.col("size")))
    s = combined(spark, sf_dir).groupBy("symbol").agg(F.count_if(big).alias("events"), F.max("size").alias("largest"), of(big & (F.col("side") > 0)).alias("bought"), of(big & (F.col("side") < 0)).alias("sold"), (of(big) / F.sum("size")).alias("share"))
    side = F.when(F.expr("bought > 1.5 * sold"), "buy").when(F.expr("sold > 1.5 * bought"), "sell").otherwise("mixed")
    score = F.round(F.col("largest") / 50 + 0.3 * F.log1p(F.greatest(F.col("events") - 1, F.lit(0))), 6)
    return s.select("symbol", "events", "largest", side.alias("side"), F.round("share", 6).alias("share"), score.alias("score")).orderBy(F.desc("score"), "symbol").limit(20)


@query(f"WITH e AS (SELECT symbol, bar_s, close FROM {BARS} WHERE volume > 100), p AS (SELECT e.symbol, e.bar_s AS entry_s, e.close AS entry, b.bar_s, b.high, b.low, b.close FROM e JOIN {BARS} b ON b.symbol = e.symbol AND b.bar_s > e.bar_s AND b.bar_s <= e.bar_s + 28800) SELECT symbol, entry_s, round(max(high) / any_value(entry) - 1, 6) AS best, arg_max(bar_s, struct_pack(h := high, t := -bar_s)) AS best_s, round(min(low) / any_value(entry) - 1, 6) AS worst, round(arg_max(close, bar_s) / any_value(entry) - 1, 6) AS last FROM p GROUP BY 1, 2")
def entry_performance(spark, sf_dir):
    """From an entry, the best and worst return of the next eight hours, when the best came first, and the last."""
    ahead = R.over().rangeBetween(1, 28_800)
    b = hourly(spark, sf_dir).withColumns({
        "best": F.max("high").over(ahead) / F.col("close") - 1, "worst": F.min("low").over(ahead) / F.col("close") - 1,
        "top": F.max(F.struct("high", (-F.col("bar_s")).alias("at"))).over(ahead), "end": F.max(F.struct("bar_s", F.col("close").alias("then"))).over(ahead)})
    return b.where("volume > 100 and end is not null").select("symbol", F.col("bar_s").alias("entry_s"), F.round("best", 6).alias("best"), (-F.col("top.at")).alias("best_s"), F.round("worst", 6).alias("worst"), F.round(F.col("end.then") / F.col("close") - 1, 6).alias("last"))


# Aggregates and evaluation (D, J).

@query(f"WITH d AS (SELECT symbol, day, high - low AS width, close > open AS up, avg(high - low) OVER (PARTITION BY symbol) AS usual FROM ({_DAILY})) SELECT symbol, count(*) AS pool, count(*) FILTER (WHERE up) AS hits, count(*) FILTER (WHERE width > usual) AS wide_pool, count(*) FILTER (WHERE up AND width > usual) AS wide_hits, round(quantile_cont(width, 0.5), 6) AS median FROM d GROUP BY 1")
def base_rates(spark, sf_dir):
    """Hits over their pool, and over the pool of wide days only."""
    d = daily(spark, sf_dir).select("symbol", (F.col("high") - F.col("low")).alias("width"), (F.col("close") > F.col("open")).alias("up"))
    d = d.withColumn("wide", F.col("width") > F.avg("width").over(W.partitionBy("symbol")))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("pool"), F.count_if("up").alias("hits"), F.count_if("wide").alias("wide_pool"), F.count_if(F.col("up") & F.col("wide")).alias("wide_hits"), F.round(F.percentile("width", F.lit(0.5)), 6).alias("median"))


@query(f"WITH s AS (SELECT symbol, quantity, quantity * (sold_at - bought_at) AS pnl, CASE WHEN sold_at >= 1.1 * bought_at THEN 'target' WHEN sold_at <= 0.9 * bought_at THEN 'stop' ELSE 'time' END AS reason, symbol % 5 AS kind FROM ({_FIFO})) SELECT kind, reason, count(*) AS n, round(sum(pnl), 4) AS net, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS won FROM s GROUP BY GROUPING SETS ((kind), (reason), ())")
def pnl_splits(spark, sf_dir):
    """Results by kind and by reason of exit, in one pass."""
    s = books.fifo(T.fills(spark, sf_dir))
    s = s.select((F.col("symbol") % 5).alias("kind"), "pnl", F.when(F.expr("sold_at >= 1.1 * bought_at"), "target").when(F.expr("sold_at <= 0.9 * bought_at"), "stop").otherwise("time").alias("reason"))
    sums = (F.count(F.lit(1)).alias("n"), F.round(F.sum("pnl"), 4).alias("net"), F.round(F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)), 6).alias("won"))
    return s.groupingSets([["kind"], ["reason"], []], "kind", "reason").agg(*sums)


@query(f"WITH s AS (SELECT CASE WHEN sold_at >= 1.1 * bought_at THEN 'target' WHEN sold_at <= 0.9 * bought_at THEN 'stop' ELSE 'time' END AS reason FROM ({_FIFO})) SELECT reason, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY 1")
def exit_mix(spark, sf_dir):
    reason = F.when(F.expr("sold_at >= 1.1 * bought_at"), "target").when(F.expr("sold_at <= 0.9 * bought_at"), "stop").otherwise("time")
    n = books.fifo(T.fills(spark, sf_dir)).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 6))  # three rows


@query(f"WITH m AS (SELECT symbol, close - avg(close) OVER (PARTITION BY symbol ORDER BY bar_s ROWS 11 PRECEDING) AS gap, bar_s, count(*) OVER (PARTITION BY symbol ORDER BY bar_s) AS held FROM {BARS}), l AS (SELECT symbol, arg_max(gap, bar_s) AS gap, max(held) AS held, max(bar_s) AS newest FROM m GROUP BY 1) SELECT count(*) AS cohort, count(*) FILTER (WHERE held >= 120 AND newest >= (SELECT max(bar_s) FROM m) - 14400) AS fresh, count(*) FILTER (WHERE held >= 120 AND newest >= (SELECT max(bar_s) FROM m) - 14400 AND gap > 0) AS rising FROM l")
def cohort_breadth(spark, sf_dir):
    """How many of the symbols with history enough and a bar of late are above their mean."""
    b = hourly(spark, sf_dir).withColumns({"gap": F.col("close") - F.avg("close").over(R.over().rowsBetween(-11, 0)), "held": F.count(F.lit(1)).over(R.over())})
    last = b.groupBy("symbol").agg(F.max_by("gap", "bar_s").alias("gap"), F.max("held").alias("held"), F.max("bar_s").alias("newest"))
    last = last.withColumn("fresh", (F.col("held") >= 120) & (F.col("newest") >= F.max("newest").over(W.partitionBy(F.lit(0))) - 14_400))  # a row a symbol
    return last.agg(F.count(F.lit(1)).alias("cohort"), F.count_if("fresh").alias("fresh"), F.count_if(F.col("fresh") & (F.col("gap") > 0)).alias("rising"))


_AXES = f"SELECT symbol, day, side, CASE WHEN volume > 0 THEN least(100, volume / 10.0) END AS flow, CASE WHEN day % 4 != 0 THEN 50 + CASE WHEN side = 'CE' THEN 1 ELSE -1 END * least(50, greatest(-50, (close - open) / 2)) END AS trend, 100 * (CASE WHEN side = 'CE' THEN close - low ELSE high - close END) / nullif(high - low, 0) AS place FROM ({_DAILY}) CROSS JOIN (SELECT unnest(['CE', 'PE']) AS side)"


@query(f"SELECT symbol, day, side, round((coalesce(0.5 * flow, 0) + coalesce(0.3 * trend, 0) + coalesce(0.2 * place, 0)) / (CASE WHEN flow IS NULL THEN 0 ELSE 0.5 END + CASE WHEN trend IS NULL THEN 0 ELSE 0.3 END + CASE WHEN place IS NULL THEN 0 ELSE 0.2 END), 4)::DOUBLE AS conviction FROM ({_AXES}) WHERE (flow IS NOT NULL)::INT + (trend IS NOT NULL)::INT + (place IS NOT NULL)::INT >= 2")
def conviction(spark, sf_dir):
    """Axes from 0 to 100 fused for either side; those missing are left out, and two at least are needed."""
    d = daily(spark, sf_dir).withColumn("side", F.explode(F.array(F.lit("CE"), F.lit("PE"))))
    call = F.col("side") == "CE"
    d = d.select("symbol", "day", "side", F.when(F.col("volume") > 0, F.least(F.lit(100.0), F.col("volume") / 10)).alias("flow"),
                 F.when(F.col("day") % 4 != 0, 50 + F.when(call, 1).otherwise(-1) * F.least(F.lit(50.0), F.greatest(F.lit(-50.0), F.expr("(close - open) / 2")))).alias("trend"),
                 (100 * F.when(call, F.expr("close - low")).otherwise(F.expr("high - close")) / F.nullif(F.expr("high - low"), F.lit(0.0))).alias("place"))
    weight = {"flow": 0.5, "trend": 0.3, "place": 0.2}
    total = sum(F.coalesce(k * F.col(c), F.lit(0.0)) for c, k in weight.items())
    held = sum(F.when(F.col(c).isNotNull(), k).otherwise(0.0) for c, k in weight.items())
    axes = sum(F.col(c).isNotNull().cast("int") for c in weight)
    return d.where(axes >= 2).select("symbol", "day", "side", F.round(total / held, 4).alias("conviction"))


@query(f"WITH d AS (SELECT DISTINCT bar_s // 86400 AS day FROM {BARS}), k AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM d) SELECT symbol, k.n AS last_n, (SELECT max(n) FROM k) - k.n AS sessions_old FROM (SELECT symbol, max(bar_s // 86400) AS day FROM {BARS} WHERE close > 60 GROUP BY 1) s JOIN k ON k.day = s.day")
def freshness(spark, sf_dir):
    """How many observed sessions ago a symbol last closed high."""
    b = hourly(spark, sf_dir).withColumn("day", F.expr("bar_s div 86400"))
    n = b.select("day").distinct().withColumn("n", F.row_number().over(W.orderBy("day")).cast("long"))  # a row a day
    n = n.withColumn("all", F.max("n").over(W.partitionBy(F.lit(0))))
    last = b.where("close > 60").groupBy("symbol").agg(F.max("day").alias("day"))
    return last.join(F.broadcast(n), "day").select("symbol", F.col("n").alias("last_n"), (F.col("all") - F.col("n")).alias("sessions_old"))


@query(f"SELECT symbol, n, round(CASE WHEN mean / (sd / sqrt(n)) >= 0.2 THEN least(0.1, greatest(0, 0.25 * mean / (sd * sd))) ELSE 0 END, 6) AS fraction FROM (SELECT symbol, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd FROM (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS r FROM {CLOSES}) GROUP BY 1)")
def fractional_kelly(spark, sf_dir):
    """A quarter of Kelly's stake, none where the mean is not clear of nought, and capped."""
    w = W.partitionBy("symbol").orderBy("month")
    s = T.closes(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(w) - 1).groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    stake = F.least(F.lit(0.1), F.greatest(F.lit(0.0), F.expr("0.25 * mean / (sd * sd)")))
    return s.select("symbol", "n", F.round(F.when(F.expr("mean / (sd / sqrt(n)) >= 0.2"), stake).otherwise(0.0), 6).alias("fraction"))


_XY = f"SELECT (volume - avg(volume) OVER ()) / stddev_pop(volume) OVER () AS x1, (high - low - avg(high - low) OVER ()) / stddev_pop(high - low) OVER () AS x2, ahead - avg(ahead) OVER () AS y FROM (SELECT *, lead(close) {OVER} ) / close - 1 AS ahead FROM {BARS}) WHERE ahead IS NOT NULL".replace("ORDER BY bar_s )", "ORDER BY bar_s)")


@query(f"SELECT round((b22 * c1 - b12 * c2) / (b11 * b22 - b12 * b12), 6) AS w1, round((b11 * c2 - b12 * c1) / (b11 * b22 - b12 * b12), 6) AS w2, n FROM (SELECT sum(x1 * x1) + 10 AS b11, sum(x2 * x2) + 10 AS b22, sum(x1 * x2) AS b12, sum(x1 * y) AS c1, sum(x2 * y) AS c2, count(*) AS n FROM ({_XY}))")
def ridge(spark, sf_dir):
    """Two standardised features on the next return, by normal equations with a penalty of 10: five sums over all rows."""
    b = hourly(spark, sf_dir).select("volume", (F.col("high") - F.col("low")).alias("width"), (F.lead("close").over(R.over()) / F.col("close") - 1).alias("ahead")).where("ahead is not null")
    m = b.agg(*[f(c).alias(f"{n}_{c}") for c in ("volume", "width", "ahead") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    x = b.join(F.broadcast(m)).select(F.expr("(volume - m_volume) / s_volume").alias("x1"), F.expr("(width - m_width) / s_width").alias("x2"), F.expr("ahead - m_ahead").alias("y"))  # one row of means
    s = x.agg((F.sum(F.expr("x1 * x1")) + 10).alias("b11"), (F.sum(F.expr("x2 * x2")) + 10).alias("b22"), F.sum(F.expr("x1 * x2")).alias("b12"), F.sum(F.expr("x1 * y")).alias("c1"), F.sum(F.expr("x2 * y")).alias("c2"), F.count(F.lit(1)).alias("n"))
    return s.select(F.expr("round((b22 * c1 - b12 * c2) / (b11 * b22 - b12 * b12), 6)").alias("w1"), F.expr("round((b11 * c2 - b12 * c1) / (b11 * b22 - b12 * b12), 6)").alias("w2"), "n")


_RANKED = f"SELECT bar_s // 86400 AS day, ceil(volume / 100.0)::BIGINT AS gain, row_number() OVER (PARTITION BY bar_s // 86400 ORDER BY close DESC, symbol, bar_s) AS n, row_number() OVER (PARTITION BY bar_s // 86400 ORDER BY volume DESC, symbol, bar_s) AS best FROM {BARS}"


@query(f"SELECT day, round(sum(CASE WHEN n <= 5 THEN (pow(2, least(gain, 4)) - 1) / log2(n + 1) END) / nullif(sum(CASE WHEN best <= 5 THEN (pow(2, least(gain, 4)) - 1) / log2(best + 1) END), 0), 6) AS ndcg, avg(CASE WHEN n <= 5 THEN CASE WHEN best <= 5 THEN 1.0 ELSE 0.0 END END) AS precision, count(*) FILTER (WHERE n <= 5 AND best <= 5) AS overlap FROM ({_RANKED}) GROUP BY 1")
def ranking_at_five(spark, sf_dir):
    """Gain at 5 against the best order, precision at 5 and overlap of the two leading fives."""
    by = W.partitionBy("day")
    b = hourly(spark, sf_dir).withColumn("day", F.expr("bar_s div 86400"))
    b = b.select("day", F.least(F.ceil(F.col("volume") / 100), F.lit(4)).alias("gain"), F.row_number().over(by.orderBy(F.desc("close"), "symbol", "bar_s")).alias("n"), F.row_number().over(by.orderBy(F.desc("volume"), "symbol", "bar_s")).alias("best"))
    gain = lambda c: F.sum(F.when(F.col(c) <= 5, (F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col(c) + 1)))
    both = (F.col("n") <= 5) & (F.col("best") <= 5)
    return b.groupBy("day").agg(F.round(gain("n") / F.nullif(gain("best"), F.lit(0.0)), 6).alias("ndcg"), F.avg(F.when(F.col("n") <= 5, both.cast("double"))).alias("precision"), F.count_if(both).alias("overlap"))


@query(f"WITH r AS (SELECT bar_s // 86400 AS day, volume, lead(close) {OVER}) / close - 1 AS ahead FROM {BARS}), q AS (SELECT *, ntile(5) OVER (ORDER BY volume, day, ahead) AS bin FROM r WHERE ahead IS NOT NULL), m AS (SELECT bin, day, avg(ahead) AS mean FROM q GROUP BY 1, 2) SELECT bin, count(*) AS sessions, round(avg(mean), 6) AS mean, round(avg(mean) - 1.96 * stddev_samp(mean) / sqrt(count(*)), 6) AS lower FROM m GROUP BY 1")
def return_calibration(spark, sf_dir):
    """Returns by fifths of the score: session means and the lower bound of their mean."""
    r = hourly(spark, sf_dir).select(F.expr("bar_s div 86400").alias("day"), "volume", (F.lead("close").over(R.over()) / F.col("close") - 1).alias("ahead")).where("ahead is not null")
    placed = ranks.numbered(r, ["volume", "day", "ahead"], folder(spark))
    m = placed.withColumn("bin", ranks.tile(F.col("place"), placed.count(), 5)).groupBy("bin", "day").agg(F.avg("ahead").alias("mean"))
    return m.groupBy("bin").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("mean"), 6).alias("mean"), F.round(F.avg("mean") - 1.96 * F.stddev_samp("mean") / F.sqrt(F.count(F.lit(1))), 6).alias("lower"))


@query(f"WITH d AS (SELECT DISTINCT bar_s // 86400 AS day FROM {BARS}), k AS (SELECT day, percent_rank() OVER (ORDER BY day) AS p FROM d), f AS (SELECT min(CASE WHEN p >= 0.6 THEN day END) AS a, min(CASE WHEN p >= 0.8 THEN day END) AS b FROM k) SELECT part, count(*) AS n, max(known) AS last_known FROM (SELECT day + 2 AS known, CASE WHEN day >= b THEN 'test' WHEN day >= a AND day + 2 < b THEN 'tune' WHEN day < a AND day + 2 < a THEN 'train' ELSE 'purged' END AS part FROM (SELECT bar_s // 86400 AS day FROM {BARS}), f) GROUP BY 1")
def purged_split(spark, sf_dir):
    """60, 20 and 20 per cent of sessions in order; rows whose label is known only after the next part begins go."""
    b = hourly(spark, sf_dir).select(F.expr("bar_s div 86400").alias("day"))
    k = b.distinct().withColumn("p", F.percent_rank().over(W.orderBy("day")))  # a row a day
    cuts = k.agg(F.min(F.when(F.col("p") >= 0.6, F.col("day"))).alias("a"), F.min(F.when(F.col("p") >= 0.8, F.col("day"))).alias("b"))
    part = F.when(F.expr("day >= b"), "test").when(F.expr("day >= a and day + 2 < b"), "tune").when(F.expr("day < a and day + 2 < a"), "train").otherwise("purged")
    return b.join(F.broadcast(cuts)).select(part.alias("part"), (F.col("day") + 2).alias("known")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("last_known"))


@query(f"WITH r AS (SELECT symbol, bar_s // 86400 AS day, lead(close) {OVER}) / close - 1 AS ahead FROM {BARS}), t AS (SELECT DISTINCT day FROM r) SELECT t.day, count(*) AS trained_on, round(avg(r.ahead), 6) AS expected FROM t JOIN r ON r.day < t.day - 3 AND r.day >= t.day - 23 WHERE r.ahead IS NOT NULL GROUP BY 1 HAVING count(DISTINCT r.day) >= 5")
def walk_forward(spark, sf_dir):
    """For each day, what was to be expected from labelled days that ended three before it, five at least."""
    r = hourly(spark, sf_dir).select(F.expr("bar_s div 86400").alias("day"), (F.lead("close").over(R.over()) / F.col("close") - 1).alias("ahead")).where("ahead is not null")
    days = r.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("ahead").alias("total"))  # a row a day
    w = W.orderBy("day").rangeBetween(-23, -4)
    out = days.select("day", F.sum("n").over(w).alias("trained_on"), F.round(F.sum("total").over(w) / F.sum("n").over(w), 6).alias("expected"), F.count(F.lit(1)).over(w).alias("held"))
    return out.where("held >= 5").drop("held")


@query(f"WITH r AS (SELECT symbol, month // 12 AS year, month % 12 < 6 AS early, close / lag(close) OVER w - 1 > 0 AS rose, lead(close) OVER w / close - 1 AS ahead FROM {CLOSES} WINDOW w AS (PARTITION BY symbol ORDER BY month)), c AS (SELECT year, unnest([CASE WHEN rose THEN 'rose' END, CASE WHEN early THEN 'early' END]) AS condition, ahead, avg(ahead) OVER (PARTITION BY year) AS usual FROM r WHERE ahead IS NOT NULL), y AS (SELECT condition, year, avg(ahead) - avg(usual) AS lift FROM c WHERE condition IS NOT NULL GROUP BY 1, 2) SELECT condition, count(*) AS years, bool_and(lift > 0) AS always, round(avg(lift), 6) AS lift FROM y GROUP BY 1")
def condition_scorecard(spark, sf_dir):
    """Conditions by whether their lift over the year's mean was positive in every year."""
    w = W.partitionBy("symbol").orderBy("month")
    r = T.closes(spark, sf_dir).select(F.expr("month div 12").alias("year"), (F.col("month") % 12 < 6).alias("early"), (F.col("close") / F.lag("close").over(w) - 1 > 0).alias("rose"), (F.lead("close").over(w) / F.col("close") - 1).alias("ahead")).where("ahead is not null")
    r = r.withColumn("usual", F.avg("ahead").over(W.partitionBy("year"))).withColumn("condition", F.explode(F.array(F.when(F.col("rose"), "rose"), F.when(F.col("early"), "early")))).where("condition is not null")
    y = r.groupBy("condition", "year").agg((F.avg("ahead") - F.avg("usual")).alias("lift"))
    return y.groupBy("condition").agg(F.count(F.lit(1)).alias("years"), F.every(F.col("lift") > 0).alias("always"), F.round(F.avg("lift"), 6).alias("lift"))


# Books (K), scalars (M).

@query(f"SELECT symbol, round((sum(price * quantity) + 2 * 20) / (sum(quantity) * (1 - 0.0005)), 6) AS breakeven FROM ({_FILLS}) WHERE side = 'BUY' GROUP BY 1")
def breakeven(spark, sf_dir):
    """The exit price that pays for the position, both brokerages and slippage."""
    b = T.fills(spark, sf_dir).where("side = 'BUY'").groupBy("symbol").agg(F.sum(F.col("price") * F.col("quantity")).alias("cost"), F.sum("quantity").alias("held"))
    return b.select("symbol", F.round((F.col("cost") + 2 * 20) / (F.col("held") * (1 - 0.0005)), 6).alias("breakeven"))


@query(f"SELECT side, count(*) AS fills, round(sum(stt + exchange + levy + stamp + brokerage + 0.18 * (exchange + levy + brokerage) + half), 2) AS charges FROM (SELECT side, CASE WHEN side = 'SELL' THEN 0.001 * v ELSE 0 END AS stt, 0.0005 * v AS exchange, 0.000001 * v AS levy, CASE WHEN side = 'BUY' THEN 0.00003 * v ELSE 0 END AS stamp, 20.0 AS brokerage, greatest(0.05, price * CASE WHEN price < 20 THEN 0.02 WHEN price < 100 THEN 0.01 ELSE 0.005 END) / 2 * quantity AS half FROM (SELECT side, price, quantity, price * quantity AS v FROM ({_FILLS}))) GROUP BY 1")
def all_charges(spark, sf_dir):
    """Tax on sales, exchange, levy, stamp on purchases, brokerage, tax on services, and half the spread by price."""
    f = T.fills(spark, sf_dir).withColumn("v", F.col("price") * F.col("quantity"))
    sell, v = F.col("side") == "SELL", F.col("v")
    exchange, levy, brokerage = 0.0005 * v, 0.000001 * v, F.lit(20.0)
    spread = F.greatest(F.lit(0.05), F.col("price") * F.when(F.col("price") < 20, 0.02).when(F.col("price") < 100, 0.01).otherwise(0.005)) / 2 * F.col("quantity")
    total = F.when(sell, 0.001 * v).otherwise(0.00003 * v) + exchange + levy + brokerage + 0.18 * (exchange + levy + brokerage) + spread
    return f.groupBy("side").agg(F.count(F.lit(1)).alias("fills"), F.round(F.sum(total), 2).alias("charges"))


@query(f"SELECT a.symbol, a.bar_s, b.exit_s FROM {BARS} a ASOF JOIN (SELECT symbol, bar_s AS exit_s, close AS at FROM {BARS} WHERE close < 20) b ON a.symbol = b.symbol AND a.bar_s > b.exit_s WHERE a.close > b.at AND a.bar_s - b.exit_s <= 43200")
def re_entries(spark, sf_dir):
    """Bars at which a symbol left within half a day trades above where it was left."""
    before = R.over().rowsBetween(W.unboundedPreceding, -1)
    left = F.last(F.when(F.col("close") < 20, F.struct(F.col("bar_s").alias("exit_s"), F.col("close").alias("at"))), ignorenulls=True).over(before)
    b = hourly(spark, sf_dir).withColumn("left_", left)
    return b.where("close > left_.at and bar_s - left_.exit_s <= 43200").select("symbol", "bar_s", "left_.exit_s")


# Indicators (F).

def _weighted(x: str, n: int) -> str:
    return f"(CASE WHEN lag({x}, {n - 1}) OVER w IS NOT NULL THEN (" + " + ".join(f"{n - i} * " + (x if not i else f"lag({x}, {i}) OVER w") for i in range(n)) + f") / {n * (n + 1) / 2} END)"


@query(f"SELECT symbol, bar_s, round({_weighted('raw', 3)}, 6) AS hull FROM (SELECT symbol, bar_s, 2 * {_weighted('close', 4)} - {_weighted('close', 9)} AS raw FROM {BARS} WINDOW w AS (PARTITION BY symbol ORDER BY bar_s)) WINDOW w AS (PARTITION BY symbol ORDER BY bar_s)")
def hull_average(spark, sf_dir):
    """Hull's mean of 9: the weighted mean of 3 of twice that of 4 less that of 9."""
    w = R.over()

    def weighted(x, n):
        return sum((n - i) * (F.lag(x, i).over(w) if i else F.col(x)) for i in range(n)) / (n * (n + 1) / 2)

    b = hourly(spark, sf_dir).withColumn("raw", 2 * weighted("close", 4) - weighted("close", 9))
    return b.select("symbol", "bar_s", F.round(weighted("raw", 3), 6).alias("hull"))


@query(f"SELECT symbol, day, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in {"p": "p", "r1": "2 * p - pl", "s1": "2 * p - ph", "r2": "p + ph - pl", "s2": "p - ph + pl", "bc": "(ph + pl) / 2", "tc": "2 * p - (ph + pl) / 2"}.items()) + f" FROM (SELECT *, (ph + pl + pc) / 3 AS p FROM (SELECT symbol, day, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM ({_DAILY}) WINDOW w AS (PARTITION BY symbol ORDER BY day))) WHERE p IS NOT NULL")
def central_pivots(spark, sf_dir):
    """All floor pivots and the central range of the session before."""
    from ..operators import indicators as I

    w = W.partitionBy("symbol").orderBy("day")
    d = daily(spark, sf_dir).withColumns({k: F.lag(c).over(w) for k, c in (("ph", "high"), ("pl", "low"), ("pc", "close"))}).where("pc is not null")
    names = ("p", "r1", "s1", "r2", "s2", "bc", "tc")
    return I.pivots(d).select("symbol", "day", *[F.round(c, 6).alias(c) for c in names])


@query("SELECT symbol, bar_s FROM (SELECT m.symbol, m.bar_s, m.macd, lag(m.macd) OVER (PARTITION BY m.symbol ORDER BY m.bar_s) AS before, row_number() OVER (PARTITION BY m.symbol ORDER BY m.bar_s) AS n, c.roc FROM (" + catalog.SQL["macd"] + ") m JOIN (" + catalog.SQL["roc"] + ") c ON c.symbol = m.symbol AND c.bar_s = m.bar_s) WHERE before <= 0 AND macd > 0 AND n > 26 AND roc > 0")
def confirmed_crosses(spark, sf_dir):
    """Zero crossings of MACD that the rate of change agrees with."""
    m = catalog.macd(spark, sf_dir).withColumns({"before": F.lag("macd").over(R.over()), "n": F.row_number().over(R.over())})
    return m.join(catalog.roc(spark, sf_dir), ["symbol", "bar_s"]).where("before <= 0 and macd > 0 and n > 26 and roc > 0").select("symbol", "bar_s")


@query(f"SELECT symbol, bar_s, seq FROM (SELECT symbol, seq, ts_s // 3600 * 3600 AS bar_s, row_number() OVER (PARTITION BY symbol, ts_s // 3600 ORDER BY seq) AS n FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM {TICKS}) WHERE before < 50 AND price >= 50) WHERE n = 1")
def one_shot_signals(spark, sf_dir):
    """A forming bar may fire once: the first crossing of 50 within it."""
    t = T.ticks(spark, sf_dir).withColumn("before", F.lag("price").over(W.partitionBy("symbol").orderBy("seq"))).where("before < 50 and price >= 50")
    t = t.withColumn("bar_s", F.expr("ts_s div 3600 * 3600"))
    return t.withColumn("n", F.row_number().over(W.partitionBy("symbol", "bar_s").orderBy("seq"))).where("n = 1").select("symbol", "bar_s", "seq")


@query("SELECT symbol, bar_s, histogram FROM (SELECT symbol, arg_max(bar_s, bar_s) AS bar_s, arg_max(histogram, bar_s) AS histogram FROM (" + catalog.SQL["macd"] + ") GROUP BY 1) ORDER BY abs(histogram) DESC, symbol LIMIT 3")
def live_ranking(spark, sf_dir):
    """The newest state of each symbol, the strongest first."""
    last = catalog.macd(spark, sf_dir).groupBy("symbol").agg(F.max("bar_s").alias("bar_s"), F.max_by("histogram", "bar_s").alias("histogram"))
    return last.orderBy(F.desc(F.abs("histogram")), "symbol").limit(3)


# Streams (N), each with its batch twin.

@query(f"WITH w AS (SELECT symbol, size, unnest([(ts_s // 1800) * 1800, (ts_s // 1800) * 1800 - 1800]) AS begin_s FROM {TICKS}) SELECT symbol, begin_s, count(*) AS n, sum(size)::BIGINT AS volume FROM w WHERE begin_s + 3600 <= (SELECT max(ts_s) FROM {TICKS}) - 600 GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    s = live.sliding(live.events(spark, sf_dir), "1 hour", "30 minutes").select("symbol", F.unix_timestamp("window.start").alias("begin_s"), "n", "volume")
    return live.drained(s, folder(spark))


@query(f"SELECT t.symbol, t.seq, b.usual FROM {TICKS} t JOIN (SELECT symbol, round(avg(size), 6) AS usual FROM {TICKS} GROUP BY 1) b ON b.symbol = t.symbol WHERE t.size > 1.5 * b.usual")
def stream_enriched(spark, sf_dir):
    """Each event joined with a table at rest, and kept where it stands out."""
    usual = T.ticks(spark, sf_dir).groupBy("symbol").agg(F.round(F.avg("size"), 6).alias("usual"))  # a row a symbol
    s = live.events(spark, sf_dir).join(F.broadcast(usual), "symbol").where(F.col("size") > 1.5 * F.col("usual")).select("symbol", "seq", "usual")
    return live.drained(s, folder(spark))


@query(f"SELECT symbol, count(*) AS seen, count(*) FILTER (WHERE received_s - ts_s > 240) AS late, count(*) FILTER (WHERE ts_s % 86400 < 33300 OR ts_s % 86400 >= 55800) AS off_session FROM (SELECT event_type AS symbol, epoch_us(ts) // 1000000 AS ts_s, epoch_us(ts) // 1000000 + user_id % 300 AS received_s FROM events) GROUP BY 1")
def late_accounting(spark, sf_dir):
    """Ticks that came late or outside the session, counted beside all."""
    at = F.col("ts_s") % T.DAY_S
    return T.quotes(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("received_s") - F.col("ts_s") > 240).alias("late"), F.count_if((at < T.OPEN_S) | (at >= 55_800)).alias("off_session"))


@query(f"WITH RECURSIVE t AS (SELECT symbol, ts_s, row_number() OVER (PARTITION BY symbol ORDER BY ts_s, seq) AS n FROM {TICKS} WHERE size >= 45), r AS (SELECT symbol, n, ts_s, ts_s AS fired FROM t WHERE n = 1 UNION ALL SELECT t.symbol, t.n, t.ts_s, CASE WHEN t.ts_s - r.fired >= 14400 THEN t.ts_s ELSE r.fired END FROM r JOIN t ON t.symbol = r.symbol AND t.n = r.n + 1) SELECT symbol, ts_s FROM r WHERE fired = ts_s GROUP BY 1, 2")
def cooled_down(spark, sf_dir):
    """Alerts that come four hours or more after the one before that was let through."""
    t = T.ticks(spark, sf_dir).where("size >= 45").select("symbol", "ts_s").distinct()
    return trends.cooled(t, ["symbol"], "ts_s", 14_400)
