"""Registered queries that put several measures of a session into one row: sentiment, end of day, informed flow, scores of flow."""

from __future__ import annotations

from pyspark.sql import Column, Window as W, functions as F

from ..sources import tables as T
from .catalog import CHAIN, CLOSES, SQL, query, steady
from .desks import BY
from .markets import _HOURLY_FLOW, hourly_flow
from .volatility import _SOLVED, surface_row, with_iv


def clipped(x: Column, scale: float) -> Column:
    """``x`` in units of ``scale``, within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / scale))


def _clip(x: str, scale: float) -> str:
    # least and greatest pass over nulls, which must stay.
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {x} / {scale}::DOUBLE)) END"


def weighted(parts: dict[str, float], least: int = 1) -> Column:
    """The mean of the columns that are there, by their weights among those; null where fewer than ``least`` are."""
    there = sum(F.col(c).isNotNull().cast("int") for c in parts)
    weight = sum(F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.items())
    total = sum(F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items())
    return F.when(there >= least, total / F.nullif(weight, F.lit(0.0)))


def _weighted(parts: dict[str, float], least: int = 1) -> str:
    there = " + ".join(f"({c} IS NOT NULL)::INTEGER" for c in parts)
    weight = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for c, w in parts.items())
    total = " + ".join(f"coalesce({c} * {w}::DOUBLE, 0)" for c, w in parts.items())
    return f"CASE WHEN {there} >= {least} THEN ({total}) / nullif({weight}, 0) END"


#: What moves a family by one, and the fewest families that make a composite.
PCR, RETURN, VOLATILITY, BIAS, FAMILIES = 0.15, 0.015, 0.03, 0.4, 3
_FAMILIES = dict.fromkeys(("pcr_part", "return_part", "volatility_part", "bias_part"), 1.0)


@query(f"""WITH c AS (SELECT month, sum(oi) FILTER (WHERE option_type = 'PE') / nullif(sum(oi) FILTER (WHERE option_type = 'CE'), 0) AS pcr, (sum(oi) FILTER (WHERE option_type = 'CE') - sum(oi) FILTER (WHERE option_type = 'PE')) / sum(oi) AS bias FROM {CHAIN} GROUP BY 1),
    v AS (SELECT month, median(iv) AS iv FROM ({_SOLVED}) WHERE iv IS NOT NULL GROUP BY 1), r AS (SELECT month, median(r) AS ret, count(*) FILTER (WHERE r > 0) AS advances, count(*) FILTER (WHERE r < 0) AS declines FROM (SELECT month, close / lag(close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS r FROM {CLOSES}) WHERE r IS NOT NULL GROUP BY 1),
    j AS (SELECT c.*, v.iv, r.ret, r.advances, r.declines, pcr - lag(pcr) OVER w AS dpcr, iv - lag(iv) OVER w AS div FROM c LEFT JOIN v ON v.month = c.month LEFT JOIN r ON r.month = c.month WINDOW w AS (ORDER BY c.month)),
    p AS (SELECT *, {_clip('-dpcr', PCR)} AS pcr_part, {_clip('ret', RETURN)} AS return_part, {_clip('-div', VOLATILITY)} AS volatility_part, {_clip('bias', BIAS)} AS bias_part FROM j)
    SELECT month, round(pcr, 6) AS pcr, round(bias, 6) AS bias, round(iv, 6) AS iv, round(ret, 6) AS ret, advances, declines, round({_weighted(_FAMILIES, FAMILIES)}, 6) AS composite FROM p""")
def market_sentiment(spark, sf_dir):
    """A month's sentiment: put and call interest, volatility, advances, and a composite of what moved, from three families on."""
    side = lambda k: F.sum(F.when(F.col("option_type") == k, F.col("oi")))
    c = T.chain(spark, sf_dir).groupBy("month").agg((side("PE") / F.nullif(side("CE"), F.lit(0.0))).alias("pcr"), ((side("CE") - side("PE")) / F.sum("oi")).alias("bias"))
    v = with_iv(spark, sf_dir).where("iv is not null").groupBy("month").agg(F.median("iv").alias("iv"))
    r = T.closes(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(W.partitionBy("symbol").orderBy("month")) - 1).where("r is not null")
    r = r.groupBy("month").agg(F.median("r").alias("ret"), F.count_if(F.col("r") > 0).alias("advances"), F.count_if(F.col("r") < 0).alias("declines"))
    w = W.orderBy("month")  # a row a month
    j = c.join(v, "month", "left").join(r, "month", "left").withColumns({"dpcr": F.col("pcr") - F.lag("pcr").over(w), "div": F.col("iv") - F.lag("iv").over(w)})
    part = lambda x, scale: F.when(x.isNotNull(), clipped(x, scale))
    j = j.withColumns({"pcr_part": part(-F.col("dpcr"), PCR), "return_part": part(F.col("ret"), RETURN), "volatility_part": part(-F.col("div"), VOLATILITY), "bias_part": part(F.col("bias"), BIAS)})
    return j.select("month", *[F.round(x, 6).alias(x) for x in ("pcr", "bias", "iv", "ret")], "advances", "declines", F.round(weighted(_FAMILIES, FAMILIES), 6).alias("composite"))


_BEFORE = "PARTITION BY underlying ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING"


def _z(x: str) -> str:
    return f"CASE WHEN count({x}) OVER t >= 6 AND stddev_samp({x}) OVER t > 0 THEN ({x} - avg({x}) OVER t) / stddev_samp({x}) OVER t END"


def trailing_z(x: str, n: int = 12, least: int = 6) -> Column:
    """z of a row against the ``n`` rows before it, from ``least`` values on that vary."""
    t = W.partitionBy("underlying").orderBy("month").rowsBetween(-n, -1)
    sd = F.stddev_samp(x).over(t)
    return F.when((F.count(x).over(t) >= least) & (sd > 0), (F.col(x) - F.avg(x).over(t)) / sd)


@query(f"""WITH p AS (SELECT *, CASE WHEN lag(month) OVER w = month - 1 THEN lag(oi) OVER w END AS prior FROM {CHAIN} WINDOW w AS (PARTITION BY underlying, option_type, strike ORDER BY month)),
    s AS (SELECT underlying, month, sum(oi) FILTER (WHERE option_type = 'CE') AS call_oi, sum(oi) FILTER (WHERE option_type = 'PE') AS put_oi, sum(oi - prior) FILTER (WHERE option_type = 'CE') AS call_change, sum(oi - prior) FILTER (WHERE option_type = 'PE') AS put_change, count(*) FILTER (WHERE prior IS NULL) AS unknown,
        (max({{'oi': oi, 's': -strike}}) FILTER (WHERE option_type = 'CE')).s * -1 AS call_wall, (max({{'oi': oi, 's': -strike}}) FILTER (WHERE option_type = 'PE')).s * -1 AS put_wall FROM p GROUP BY 1, 2),
    z AS (SELECT *, put_oi / nullif(call_oi, 0) AS pcr, {_z('call_change')} AS call_z, {_z('put_change')} AS put_z FROM s WINDOW t AS ({_BEFORE})),
    r AS (SELECT *, CASE WHEN call_z IS NOT NULL OR put_z IS NOT NULL THEN (coalesce(abs(call_z), 0) + coalesce(abs(put_z), 0)) / ((call_z IS NOT NULL)::INTEGER + (put_z IS NOT NULL)::INTEGER) END AS score FROM z),
    k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY round(score, 6) DESC, underlying) AS place FROM r WHERE score IS NOT NULL)
    SELECT underlying, month, place, round(call_oi, 4) AS call_oi, round(put_oi, 4) AS put_oi, round(call_change, 4) AS call_change, round(put_change, 4) AS put_change, unknown, round(pcr, 6) AS pcr, call_wall, put_wall, round(score, 6) AS score FROM k WHERE place <= 10""")
def closing_picture(spark, sf_dir):
    """The ten underlyings a month whose interest changed most unusually; contracts without a row the month before are counted, not taken as new."""
    w = W.partitionBy("underlying", "option_type", "strike").orderBy("month")
    p = T.chain(spark, sf_dir).withColumn("prior", F.when(F.lag("month").over(w) == F.col("month") - 1, F.lag("oi").over(w)))
    call, put = F.col("option_type") == "CE", F.col("option_type") == "PE"
    wall = lambda k: F.max_by("strike", F.when(k, F.struct("oi", -F.col("strike"))))
    s = p.groupBy(*BY).agg(
        F.sum(F.when(call, F.col("oi"))).alias("call_oi"), F.sum(F.when(put, F.col("oi"))).alias("put_oi"), F.sum(F.when(call, F.col("oi") - F.col("prior"))).alias("call_change"), F.sum(F.when(put, F.col("oi") - F.col("prior"))).alias("put_change"),
        F.count_if(F.col("prior").isNull()).alias("unknown"), wall(call).alias("call_wall"), wall(put).alias("put_wall"))
    z = s.withColumns({"pcr": F.col("put_oi") / F.nullif(F.col("call_oi"), F.lit(0.0)), "call_z": F.abs(trailing_z("call_change")), "put_z": F.abs(trailing_z("put_change"))})
    z = z.withColumn("score", F.round(weighted({"call_z": 1.0, "put_z": 1.0}), 6)).where("score is not null")
    z = z.withColumn("place", F.row_number().over(W.partitionBy("month").orderBy(F.desc("score"), "underlying"))).where("place <= 10")
    return z.select(*BY, F.col("place").cast("long").alias("place"), *[F.round(x, 4).alias(x) for x in ("call_oi", "put_oi", "call_change", "put_change")], "unknown", F.round("pcr", 6).alias("pcr"), "call_wall", "put_wall", "score")


#: Weights of the parts of informed flow.
INFORMED = {"spread_part": 0.4, "skew_part": 0.35, "pcr_part": 0.25}


@query(f"""WITH s AS (SELECT a.*, c.pcr FROM ({SQL['surface_row']}) a JOIN (SELECT underlying, month, sum(oi) FILTER (WHERE option_type = 'PE') / nullif(sum(oi) FILTER (WHERE option_type = 'CE'), 0) AS pcr FROM {CHAIN} GROUP BY 1, 2) c ON c.underlying = a.underlying AND c.month = a.month),
    z AS (SELECT *, {_z('spread')} AS spread_z, {_z('skew')} AS skew_z, {_z('pcr')} AS pcr_z FROM s WINDOW t AS ({_BEFORE})), p AS (SELECT *, {_clip('spread_z', 3)} AS spread_part, {_clip('-skew_z', 3)} AS skew_part, {_clip('-pcr_z', 3)} AS pcr_part FROM z)
    SELECT underlying, month, round(spread_z, 4) AS spread_z, round(skew_z, 4) AS skew_z, round(pcr_z, 4) AS pcr_z, round(100 * {_weighted(INFORMED)}, 3) AS score FROM p WHERE {_weighted(INFORMED)} IS NOT NULL""")
def informed_flow(spark, sf_dir):
    """What volatilities of calls against puts, skew and interest say together, from -100 to 100; parts that are unknown leave their weight to the others."""
    side = lambda k: F.sum(F.when(F.col("option_type") == k, F.col("oi")))
    pcr = T.chain(spark, sf_dir).groupBy(*BY).agg((side("PE") / F.nullif(side("CE"), F.lit(0.0))).alias("pcr"))
    s = surface_row(spark, sf_dir).join(pcr, BY)
    z = s.withColumns({f"{c}_z": trailing_z(c) for c in ("spread", "skew", "pcr")})
    part = lambda x: F.when(x.isNotNull(), clipped(x, 3))
    z = z.withColumns({"spread_part": part(F.col("spread_z")), "skew_part": part(-F.col("skew_z")), "pcr_part": part(-F.col("pcr_z"))}).withColumn("score", weighted(INFORMED)).where("score is not null")
    return z.select(*BY, *[F.round(x, 4).alias(x) for x in ("spread_z", "skew_z", "pcr_z")], F.round(100 * F.col("score"), 3).alias("score"))


@query(f"""WITH f AS (SELECT symbol, bar_s, bar_s % 86400 AS slot, volume, delta, delta / nullif(volume, 0) AS nd FROM ({_HOURLY_FLOW})),
    b AS (SELECT symbol, slot, median(volume) AS usual, median(nd) AS nd_mid, (quantile_cont(nd, 0.75) - quantile_cont(nd, 0.25)) / 1.349 AS nd_width, median(delta) AS d_mid, (quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25)) / 1.349 AS d_width, count(*) AS n FROM f GROUP BY 1, 2),
    s AS (SELECT f.*, volume / nullif(usual, 0) AS rvol, (nd - nd_mid) / nullif(nd_width, 0) AS nd_z, (delta - d_mid) / nullif(d_width, 0) AS d_z, n FROM f JOIN b ON b.symbol = f.symbol AND b.slot = f.slot)
    SELECT symbol, bar_s, round(rvol + 1e-9, 6) AS rvol, round(nd_z + 1e-9, 6) AS nd_z, round(d_z + 1e-9, 6) AS d_z, round(tanh((0.6 * nd_z + 0.4 * d_z) / 2) * least(1, rvol) + 1e-9, 6) AS score, CASE WHEN n < 10 THEN 'thin baseline' WHEN rvol < 0.5 THEN 'quiet' WHEN nd_z IS NULL OR d_z IS NULL THEN 'flat baseline' ELSE 'ok' END AS reason FROM s""")
def flow_scores(spark, sf_dir):
    """The hour's flow against what its symbol usually has at that hour, by medians and quartiles, damped where little traded."""
    f = hourly_flow(spark, sf_dir).select("symbol", "bar_s", (F.col("bar_s") % T.DAY_S).alias("slot"), "volume", "delta", (F.col("delta") / F.nullif(F.col("volume"), F.lit(0))).alias("nd"))
    width = lambda c: (F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))) / 1.349
    b = f.groupBy("symbol", "slot").agg(F.median("volume").alias("usual"), F.median("nd").alias("nd_mid"), width("nd").alias("nd_width"), F.median("delta").alias("d_mid"), width("delta").alias("d_width"), F.count(F.lit(1)).alias("n"))
    z = lambda x, c: (F.col(x) - F.col(f"{c}_mid")) / F.nullif(F.col(f"{c}_width"), F.lit(0.0))
    s = f.join(b, ["symbol", "slot"]).withColumns({"rvol": F.col("volume") / F.nullif(F.col("usual"), F.lit(0.0)), "nd_z": z("nd", "nd"), "d_z": z("delta", "d")})
    score = F.tanh((0.6 * F.col("nd_z") + 0.4 * F.col("d_z")) / 2) * F.least(F.lit(1.0), F.col("rvol"))
    reason = F.when(F.col("n") < 10, "thin baseline").when(F.col("rvol") < 0.5, "quiet").when(F.col("nd_z").isNull() | F.col("d_z").isNull(), "flat baseline").otherwise("ok")
    return s.select("symbol", "bar_s", *[steady(x, 6).alias(x) for x in ("rvol", "nd_z", "d_z")], steady(score, 6).alias("score"), reason.alias("reason"))
