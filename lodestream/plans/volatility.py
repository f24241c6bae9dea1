"""Registered queries on volatilities solved from observed premiums: near the money, by day, along expiries, the surface."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import pricing
from ..operators import options as O
from ..sources import tables as T
from .catalog import CHAIN, query
from .desks import BY, N

#: The shared chain has no expiry: a contract has so many days left by its strike.
_DTE = "7 * (1 + (strike::BIGINT // 10) % 8)"


def _model(v: str) -> str:
    d1 = f"((ln(spot / strike) + {v} * {v} / 2 * t) / ({v} * sqrt(t)))"
    d2 = f"({d1} - {v} * sqrt(t))"
    return f"CASE WHEN option_type = 'CE' THEN spot * {N(d1)} - strike * {N(d2)} ELSE strike * {N(f'(-{d2})')} - spot * {N(f'(-{d1})')} END"


_AGED = f"SELECT *, {_DTE} AS dte, {_DTE} / 365.0::DOUBLE AS t, greatest(0, CASE WHEN option_type = 'CE' THEN spot - strike ELSE strike - spot END) AS edge FROM {CHAIN}"
_OPEN = f"SELECT *, premium > edge + 1e-9 AND ({_model('0.01::DOUBLE')}) <= premium AND premium <= ({_model('3.0::DOUBLE')}) AS known FROM ({_AGED})"
#: Sixty halvings of the bracket.
_HALVED = f"""SELECT *, CASE WHEN known THEN list_reduce(list_prepend({{'lo': 0.01::DOUBLE, 'hi': 3.0::DOUBLE}}, list_transform(range(60), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE}})),
    lambda a, x: CASE WHEN ({_model('((a.lo + a.hi) / 2)')}) < premium THEN {{'lo': (a.lo + a.hi) / 2, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': (a.lo + a.hi) / 2}} END) END AS bracket FROM ({_OPEN})"""
_VEGA = "(spot * exp(-pow((ln(spot / strike) + v * v / 2 * t) / (v * sqrt(t)), 2) / 2) / sqrt(2 * pi()) * sqrt(t))"
_SOLVED = f"SELECT *, CASE WHEN 0.05 / {_VEGA} <= 0.05 THEN v END AS iv FROM (SELECT *, (bracket.lo + bracket.hi) / 2 AS v FROM ({_HALVED}))"


def with_iv(spark, sf_dir):
    """The chain with days left and the volatility that its premium stands for, null where it stands for none."""
    dte = 7 * (1 + F.expr("(cast(strike as bigint) div 10) % 8"))
    c = T.chain(spark, sf_dir).withColumn("dte", dte).withColumn("t", F.col("dte") / F.lit(365.0))
    return c.withColumn("solved", pricing.solved_volatility(O.is_call(), F.col("premium"), F.col("spot"), F.col("strike"), F.col("t"), F.lit(0.0))).select("*", F.col("solved.iv").alias("iv"), F.col("solved.uncertainty").alias("uncertainty")).drop("solved")


@query(f"SELECT underlying, month, strike, option_type, round(iv, 6) AS iv, round(0.05 / {_VEGA}, 6) AS uncertainty FROM ({_SOLVED}) WHERE known")
def solved_volatility(spark, sf_dir):
    """Newton's volatility of every premium that has one, with what a tick of the premium moves it by."""
    return with_iv(spark, sf_dir).where("uncertainty is not null").select(*BY, "strike", "option_type", F.round("iv", 6).alias("iv"), F.round("uncertainty", 6).alias("uncertainty"))


_NEAR = f"SELECT underlying, month, avg(iv) AS iv, max(spot) AS spot, count(*) AS held FROM (SELECT *, row_number() OVER (PARTITION BY underlying, month ORDER BY abs(strike - spot), strike, option_type) AS n FROM ({_SOLVED}) WHERE iv IS NOT NULL) WHERE n <= 5 GROUP BY 1, 2"


def near_iv(spark, sf_dir):
    """Mean volatility of the five contracts nearest the money that have one."""
    near = F.row_number().over(W.partitionBy(*BY).orderBy(F.abs(F.col("strike") - F.col("spot")), "strike", "option_type"))
    return with_iv(spark, sf_dir).where("iv is not null").withColumn("n", near).where("n <= 5").groupBy(*BY).agg(F.avg("iv").alias("iv"), F.max("spot").alias("spot"), F.count(F.lit(1)).alias("held"))


@query(f"SELECT underlying, month, round(iv, 6) AS iv FROM ({_NEAR})")
def near_money_volatility(spark, sf_dir):
    return near_iv(spark, sf_dir).select(*BY, F.round("iv", 6).alias("iv"))


@query(f"SELECT underlying, month, elapsed, round(spot * (1 + iv * sqrt(1 / 365.0) * sqrt(elapsed / 375.0)), 5) AS upper, round(spot * (1 - iv * sqrt(1 / 365.0) * sqrt(elapsed / 375.0)), 5) AS lower FROM ({_NEAR}) CROSS JOIN (SELECT unnest([75, 150, 225, 300, 375]) AS elapsed)")
def expected_band(spark, sf_dir):
    """How far the spot may be expected to be through a session of 375 minutes."""
    n = near_iv(spark, sf_dir).withColumn("elapsed", F.explode(F.array(*[F.lit(m) for m in (75, 150, 225, 300, 375)])))
    move = F.col("iv") * F.sqrt(F.lit(1 / 365)) * F.sqrt(F.col("elapsed") / 375)
    return n.select(*BY, "elapsed", F.round(F.col("spot") * (1 + move), 5).alias("upper"), F.round(F.col("spot") * (1 - move), 5).alias("lower"))


_TRAIL = "PARTITION BY underlying ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW"


@query(f"""WITH n AS ({_NEAR}), w AS (SELECT *, list(iv) OVER ({_TRAIL}) AS held_ivs, min(iv) OVER ({_TRAIL}) AS low, max(iv) OVER ({_TRAIL}) AS high, lag(iv) OVER (PARTITION BY underlying ORDER BY month) AS before FROM n)
    SELECT underlying, month, round(iv, 6) AS iv, round((iv - low) / nullif(high - low, 0), 5) AS rank, round(len(list_filter(held_ivs, lambda x: x <= iv)) / len(held_ivs), 6) AS percentile, round(iv - before, 6) AS change FROM w WHERE len(held_ivs) >= 10""")
def volatility_rank(spark, sf_dir):
    """Volatility within its range of twelve months, the share of them at most as high, and its change; from ten months on."""
    along = W.partitionBy("underlying").orderBy("month")
    w = along.rowsBetween(-11, 0)
    low, high = F.min("iv").over(w), F.max("iv").over(w)
    n = near_iv(spark, sf_dir).withColumns({"rank": (F.col("iv") - low) / F.nullif(high - low, F.lit(0.0)), "change": F.col("iv") - F.lag("iv").over(along), "ivs": F.collect_list("iv").over(w)})  # twelve values at most
    n = n.where(F.size("ivs") >= 10).withColumn("percentile", F.size(F.filter("ivs", lambda x: x <= F.col("iv"))) / F.size("ivs"))
    return n.select(*BY, F.round("iv", 6).alias("iv"), F.round("rank", 5).alias("rank"), F.round("percentile", 6).alias("percentile"), F.round("change", 6).alias("change"))


@query(f"""WITH n AS (SELECT underlying, month // 12 AS year, month, avg(iv) AS iv FROM (SELECT * FROM ({_SOLVED}) WHERE iv IS NOT NULL AND abs(strike / spot - 1) <= 0.15) GROUP BY 1, 2, 3)
    SELECT underlying, year, count(*) AS days, round(min(iv), 6) AS low, round(max(iv), 6) AS high, round(avg(iv), 6) AS mean, round(arg_max(iv, month), 6) AS last, round((arg_max(iv, month) - min(iv)) / nullif(max(iv) - min(iv), 0), 5) AS rank FROM n GROUP BY 1, 2""")
def volatility_range(spark, sf_dir):
    """Each year's range and mean of the volatility near the money, and where its last snapshot stood."""
    n = with_iv(spark, sf_dir).where("iv is not null and abs(strike / spot - 1) <= 0.15").groupBy("underlying", F.expr("month div 12").alias("year"), "month").agg(F.avg("iv").alias("iv"))
    last = F.max_by("iv", "month")
    return n.groupBy("underlying", "year").agg(
        F.count(F.lit(1)).alias("days"), F.round(F.min("iv"), 6).alias("low"), F.round(F.max("iv"), 6).alias("high"), F.round(F.avg("iv"), 6).alias("mean"),
        F.round(last, 6).alias("last"), F.round((last - F.min("iv")) / F.nullif(F.max("iv") - F.min("iv"), F.lit(0.0)), 5).alias("rank"))


_EXPIRIES = f"SELECT underlying, month, dte, avg(iv) AS iv FROM ({_SOLVED}) WHERE iv IS NOT NULL GROUP BY 1, 2, 3"


@query(f"WITH s AS ({_EXPIRIES}), a AS (SELECT underlying, month, max(dte) FILTER (WHERE dte <= 30) AS near, min(dte) FILTER (WHERE dte > 30) AS far FROM s GROUP BY 1, 2) SELECT a.underlying, a.month, near, far, round(sqrt((n.iv * n.iv * near * (far - 30) + f.iv * f.iv * far * (30 - near)) / (far - near) / 30), 6) AS iv30 FROM a JOIN s n ON n.underlying = a.underlying AND n.month = a.month AND n.dte = near JOIN s f ON f.underlying = a.underlying AND f.month = a.month AND f.dte = far")
def constant_maturity(spark, sf_dir):
    """Volatility at 30 days, by total variance between the expiries around it."""
    s = with_iv(spark, sf_dir).where("iv is not null").groupBy(*BY, "dte").agg(F.avg("iv").alias("iv"))
    pair = F.struct("dte", "iv")
    near, far = F.max(F.when(F.col("dte") <= 30, pair)), F.min(F.when(F.col("dte") > 30, pair))
    a = s.groupBy(*BY).agg(near.alias("n"), far.alias("f")).where("n is not null and f is not null")
    total = F.col("n.iv") ** 2 * F.col("n.dte") * (F.col("f.dte") - 30) + F.col("f.iv") ** 2 * F.col("f.dte") * (30 - F.col("n.dte"))
    return a.select(*BY, F.col("n.dte").alias("near"), F.col("f.dte").alias("far"), F.round(F.sqrt(total / (F.col("f.dte") - F.col("n.dte")) / 30), 6).alias("iv30"))


_DELTA = f"SELECT *, CASE WHEN option_type = 'CE' THEN {N('d1')} ELSE {N('d1')} - 1 END AS delta FROM (SELECT *, (ln(spot / strike) + iv * iv / 2 * t) / (iv * sqrt(t)) AS d1 FROM ({_SOLVED}) WHERE iv IS NOT NULL)"


@query(f"""WITH d AS ({_DELTA}), f AS (SELECT *, row_number() OVER (PARTITION BY underlying, month, option_type ORDER BY abs(strike - spot), strike) AS k FROM d),
    g AS (SELECT underlying, month, avg(iv) FILTER (WHERE k <= 5 AND option_type = 'CE') AS call_iv, avg(iv) FILTER (WHERE k <= 5 AND option_type = 'PE') AS put_iv, min({{'off': abs(delta - 0.25), 'strike': strike, 'iv': iv}}) FILTER (WHERE option_type = 'CE') AS c25, min({{'off': abs(delta + 0.25), 'strike': strike, 'iv': iv}}) FILTER (WHERE option_type = 'PE') AS p25,
        min(delta) AS least, max(delta) AS most, count(*) AS contracts FROM f GROUP BY 1, 2)
    SELECT underlying, month, contracts, round(call_iv, 6) AS call_iv, round(put_iv, 6) AS put_iv, round(call_iv - put_iv, 6) AS spread, CASE WHEN c25.off <= 0.1 AND p25.off <= 0.1 THEN round(p25.iv - c25.iv, 6) END AS skew,
        CASE WHEN c25 IS NULL THEN 'no calls' WHEN p25 IS NULL THEN 'no puts' WHEN c25.off > 0.1 THEN 'no call near 25' WHEN p25.off > 0.1 THEN 'no put near 25' ELSE 'ok' END AS reason, round(most - least, 5) AS delta_span FROM g""")
def surface_row(spark, sf_dir):
    """A month's surface in one row: volatility of calls and puts near the money, their spread, skew at 25 delta or why there is none."""
    c = with_iv(spark, sf_dir).where("iv is not null")
    delta = pricing.greeks(O.is_call(), F.col("spot"), F.col("strike"), F.col("t"), F.lit(0.0), F.col("iv"))["delta"]
    near = F.row_number().over(W.partitionBy(*BY, "option_type").orderBy(F.abs(F.col("strike") - F.col("spot")), "strike"))
    c = c.withColumns({"delta": delta, "k": near})
    side = lambda kind: F.col("option_type") == kind
    at = lambda kind, aim: F.min(F.when(side(kind), F.struct(F.abs(F.col("delta") - aim).alias("off"), "strike", "iv")))
    g = c.groupBy(*BY).agg(
        F.avg(F.when(side("CE") & (F.col("k") <= 5), F.col("iv"))).alias("call_iv"), F.avg(F.when(side("PE") & (F.col("k") <= 5), F.col("iv"))).alias("put_iv"),
        at("CE", 0.25).alias("c25"), at("PE", -0.25).alias("p25"), F.min("delta").alias("least"), F.max("delta").alias("most"), F.count(F.lit(1)).alias("contracts"))
    reason = (F.when(F.col("c25").isNull(), "no calls").when(F.col("p25").isNull(), "no puts").when(F.col("c25.off") > 0.1, "no call near 25").when(F.col("p25.off") > 0.1, "no put near 25").otherwise("ok"))
    return g.select(*BY, "contracts", F.round("call_iv", 6).alias("call_iv"), F.round("put_iv", 6).alias("put_iv"), F.round(F.col("call_iv") - F.col("put_iv"), 6).alias("spread"),
                    F.when((F.col("c25.off") <= 0.1) & (F.col("p25.off") <= 0.1), F.round(F.col("p25.iv") - F.col("c25.iv"), 6)).alias("skew"), reason.alias("reason"), F.round(F.col("most") - F.col("least"), 5).alias("delta_span"))
