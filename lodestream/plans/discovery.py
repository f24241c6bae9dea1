"""Registered queries of models, rules found in the data, resampled intervals and clusters of series."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from ..operators import models as M, windows as R
from ..sources import tables as T
from .catalog import BARS, hourly, query
from .more import folder

FEATURES = ["ret_1", "ret_2", "range_pct", "location", "volume_ratio", "hour"]
TEST_DAYS = 5
_FEATURED = f"""SELECT symbol, bar_s, bar_s // 86400 AS day, close / lag(close) OVER w - 1 AS ret_1, close / lag(close, 2) OVER w - 1 AS ret_2, (high - low) / close AS range_pct, (close - low) / nullif(high - low, 0) AS location,
    volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY bar_s ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS volume_ratio, (bar_s % 86400 // 3600)::DOUBLE AS hour, round((lead(close) OVER w / close - 1) * 1000000)::BIGINT AS gain, lead(bar_s) OVER w // 86400 AS until
    FROM {BARS} WHERE close > 0 WINDOW w AS (PARTITION BY symbol ORDER BY bar_s)"""


def featured(spark, sf_dir):
    """Hourly bars with features known at the close and what the next hour gained, in millionths."""
    w = R.over()
    b = hourly(spark, sf_dir).where("close > 0")
    return b.select(
        "symbol", "bar_s", F.expr("bar_s div 86400").alias("day"), (F.col("close") / F.lag("close").over(w) - 1).alias("ret_1"), (F.col("close") / F.lag("close", 2).over(w) - 1).alias("ret_2"),
        ((F.col("high") - F.col("low")) / F.col("close")).alias("range_pct"), ((F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))).alias("location"),
        (F.col("volume") / F.nullif(F.avg("volume").over(w.rowsBetween(-10, -1)), F.lit(0.0))).alias("volume_ratio"), F.expr("bar_s % 86400 div 3600").cast("double").alias("hour"),
        F.round((F.lead("close").over(w) / F.col("close") - 1) * 1_000_000).cast("long").alias("gain"), F.expr("lead(bar_s) over (partition by symbol order by bar_s) div 86400").alias("until"))


def written(df):
    """``df`` as rows of the shared folder: passes over it read these and do not compute them again."""
    path = f"{folder(df.sparkSession)}/lodestream/featured-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parted(spark, sf_dir):
    """(train, test) by day: the last days are the test, and no row to train on has an outcome in them."""
    f = written(featured(spark, sf_dir).where("gain is not null"))
    last = f.agg(F.max("day")).first()[0] or 0
    return f.where((F.col("day") <= last - TEST_DAYS) & (F.col("until") <= last - TEST_DAYS)), f.where(F.col("day") > last - TEST_DAYS)


_TRAIN = f"WITH f AS (SELECT *, max(day) OVER () - {TEST_DAYS} AS cut FROM ({_FEATURED}) WHERE gain IS NOT NULL), x AS (SELECT row_number() OVER () AS r, *, day > cut AS test FROM f WHERE day > cut OR until <= cut)"


@query(f"""{_TRAIN}, v AS (SELECT r, test, gain, k, value FROM (SELECT r, test, gain, unnest([{', '.join(f"{{'k': {i}, 'value': {n}}}" for i, n in enumerate(FEATURES))}], recursive := true) FROM x) WHERE value IS NOT NULL),
    q AS (SELECT k, unnest(list_sort(list_distinct([s[greatest(1, ceil(p * len(s)))::INTEGER] for p in [0.2::DOUBLE, 0.35, 0.5, 0.65, 0.8]]))) AS threshold FROM (SELECT k, list_sort(list(value)) AS s FROM v WHERE NOT test GROUP BY 1)),
    c AS (SELECT *, row_number() OVER (ORDER BY k, threshold, op DESC) AS id FROM (SELECT k, threshold, unnest(['>=', '<=']) AS op FROM q)),
    h AS (SELECT v.r, v.test, v.gain, c.id, c.k FROM v JOIN c ON c.k = v.k AND CASE WHEN op = '>=' THEN value >= threshold ELSE value <= threshold END),
    p AS (SELECT a.id AS i, b.id AS j, count(*) FILTER (WHERE NOT a.test) AS n, coalesce(sum(a.gain) FILTER (WHERE NOT a.test), 0)::DOUBLE AS s, count(*) FILTER (WHERE a.test) AS m, sum(a.gain) FILTER (WHERE a.test)::DOUBLE AS t FROM h a JOIN h b ON b.r = a.r AND (b.id = a.id OR b.id > a.id AND b.k <> a.k) GROUP BY 1, 2),
    o AS (SELECT *, s / n * sqrt(n) AS score FROM p WHERE n >= 12 AND s > 0 ORDER BY score DESC, i, j LIMIT 20)
    SELECT row_number() OVER (ORDER BY score DESC, i, j)::INTEGER AS place, ['{"', '".join(FEATURES)}'][a.k + 1] AS feature, a.op, round(a.threshold, 9) AS threshold, CASE WHEN i <> j THEN ['{"', '".join(FEATURES)}'][b.k + 1] END AS feature2, CASE WHEN i <> j THEN b.op END AS op2, CASE WHEN i <> j THEN round(b.threshold, 9) END AS threshold2,
        n AS n_train, round(s / n, 4) AS mean_train, round(score, 3) AS score, m AS n_test, round(t / m, 4) AS mean_test FROM o JOIN c a ON a.id = i JOIN c b ON b.id = j""")
def threshold_rules(spark, sf_dir):
    """The twenty best rules of one or two conditions on the features, and how they did on days held out."""
    train, test = parted(spark, sf_dir)
    out = M.rules(train, test, FEATURES, "gain")
    return out.withColumns({c: F.round(c, d) for c, d in (("threshold", 9), ("threshold2", 9), ("mean_train", 4), ("score", 3), ("mean_test", 4))})


_DAYS = f"SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM (SELECT symbol, bar_s // 86400 AS day, arg_max(close, bar_s) AS close FROM {BARS} WHERE close > 0 GROUP BY 1, 2)"


@query(f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i FROM ({_DAYS}) WHERE ret IS NOT NULL), s AS (SELECT symbol, count(*) AS blocks, avg(ret) AS mean FROM v GROUP BY 1),
    d AS (SELECT symbol, blocks, r, unnest(range(blocks)) AS k FROM (SELECT symbol, blocks, unnest(range(500)) AS r FROM s)),
    m AS (SELECT d.symbol, d.r, avg(v.ret) AS m FROM d JOIN v ON v.symbol = d.symbol AND v.i = ('0x' || substr(md5('days:' || d.r || ':' || d.k), 1, 12))::BIGINT % d.blocks GROUP BY 1, 2)
    SELECT symbol, any_value(blocks) AS blocks, round(any_value(mean), 7) AS mean, round(quantile_cont(m, 0.025), 7) AS low, round(quantile_cont(m, 0.975), 7) AS high FROM m JOIN s USING (symbol) GROUP BY 1""")
def bootstrap_interval(spark, sf_dir):
    """The mean day's return of each symbol and its interval over 500 resamples of days."""
    d = hourly(spark, sf_dir).where("close > 0").groupBy("symbol", F.expr("bar_s div 86400").alias("day")).agg(F.max_by("close", "bar_s").alias("close"))
    d = d.withColumn("ret", F.col("close") / F.lag("close").over(W.partitionBy("symbol").orderBy("day")) - 1).where("ret is not null")
    out = M.bootstrap(d, ["symbol"], "ret", "day")
    return out.withColumns({c: F.round(c, 7) for c in ("mean", "low", "high")})


CLUSTERS = 10
_RETURNS = "SELECT name, month, price / lag(price) OVER (PARTITION BY name ORDER BY month) - 1 AS ret FROM (SELECT p_brand AS name, year(l_shipdate) * 12 + month(l_shipdate) AS month, avg(l_extendedprice / l_quantity) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE s AS ({_RETURNS}), p AS (SELECT a.name AS a, b.name AS b, CASE WHEN count(*) >= 10 THEN 1 - coalesce(corr(a.ret, b.ret), 0) ELSE 1 END AS d FROM s a JOIN s b ON a.month = b.month AND a.name < b.name WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT DISTINCT 0 AS step, name, name AS label FROM s
        UNION ALL SELECT step + 1, name, CASE WHEN label = hi THEN lo ELSE label END FROM r, (SELECT lo, hi FROM (SELECT least(x.label, y.label) AS lo, greatest(x.label, y.label) AS hi, avg(d) AS d FROM r x JOIN p ON p.a = x.name JOIN r y ON y.name = p.b WHERE x.label <> y.label GROUP BY 1, 2) ORDER BY d, lo, hi LIMIT 1)
        WHERE (SELECT count(DISTINCT label) FROM r) > {CLUSTERS})
    SELECT name, label AS cluster, count(*) OVER (PARTITION BY label) AS members FROM r WHERE step = (SELECT max(step) FROM r)""")
def correlation_clusters(spark, sf_dir):
    """Brands whose prices move alike, by average linkage cut to ten clusters."""
    line, part = T.table(spark, sf_dir, "lineitem"), T.table(spark, sf_dir, "part")
    price = line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("name"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    s = price.withColumn("ret", F.col("price") / F.lag("price").over(W.partitionBy("name").orderBy("month")) - 1)
    return M.clustered(M.correlations(s, "name", "month", "ret"), s.select("name").distinct(), CLUSTERS)


def scaled(spark, sf_dir):
    """(train, test) with the features in deviations of the train days', rows with all of them."""
    train, test = (df.dropna(subset=FEATURES) for df in parted(spark, sf_dir))
    scale = M.scaling(train, FEATURES)
    pick = lambda df: df.select("symbol", "bar_s", "day", "gain", *M.standard(FEATURES, scale))
    return pick(train), pick(test)


@query()
def entry_gate(spark, sf_dir):
    """The chance that a test hour is followed by a gain, its place among the day's, and the size that it gets."""
    train, test = scaled(spark, sf_dir)
    w = M.logistic(train.withColumn("won", (F.col("gain") > 0).cast("double")), FEATURES, "won")
    place = F.percent_rank().over(W.partitionBy("day").orderBy("chance"))
    out = test.withColumn("chance", M.logit(FEATURES, w)).withColumn("place", place)
    size = F.when(F.col("place") >= 0.8, 1.0).when(F.col("place") >= 0.5, 0.5).otherwise(0.0)
    return out.select("symbol", "bar_s", F.round("chance", 6).alias("chance"), F.round("place", 6).alias("place"), size.alias("size"))


@query()
def quantile_forecast(spark, sf_dir):
    """The tenth and ninetieth percentile of the next hour's gain, by nets fitted on the train days."""
    train, test = scaled(spark, sf_dir)
    unit = train.withColumn("target", F.col("gain") / 1_000_000)
    for name, (net, w, _) in zip(("low", "high"), M.quantile_nets(unit, FEATURES, "target", [0.1, 0.9], rounds=25), strict=True):
        test = M.scored(test, net, w, FEATURES, name)
    return test.select("symbol", "bar_s", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), "gain")


@query()
def listwise_ranking(spark, sf_dir):
    """Test hours of all symbols ranked by a net that was fitted to whole hours at a time."""
    train, test = scaled(spark, sf_dir)
    won = lambda df: df.withColumn("won", F.greatest(F.col("gain"), F.lit(0)).cast("double"))
    net, w, _ = M.listwise_net(won(train), "bar_s", FEATURES, "won", rounds=25)
    out = M.scored(test, net, w, FEATURES, "score")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("bar_s").orderBy(F.desc("score"), "symbol"))).select("symbol", "bar_s", F.round("score", 6).alias("score"), "rank", "gain")
