"""Trend, rank and genotype statistics on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import popgen
from ..sources.tables import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("""WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS x,
 rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS y FROM part)
SELECT p_brand, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(corr(x, y), 6) END AS rho FROM r GROUP BY p_brand""")
def spearman_by_group(spark, sf):
    return popgen.spearman(read(spark, sf, "part"), ["p_brand"], "p_size", "p_retailprice").withColumn("rho", F.round("rho", 6))


@query("""WITH t AS (SELECT l_suppkey, count(*) FILTER (l_linestatus = 'F' AND l_quantity <= 17) AS a0, count(*) FILTER (l_linestatus = 'F' AND l_quantity > 17 AND l_quantity <= 34) AS a1, count(*) FILTER (l_linestatus = 'F' AND l_quantity > 34) AS a2,
 count(*) FILTER (l_linestatus <> 'F' AND l_quantity <= 17) AS b0, count(*) FILTER (l_linestatus <> 'F' AND l_quantity > 17 AND l_quantity <= 34) AS b1, count(*) FILTER (l_linestatus <> 'F' AND l_quantity > 34) AS b2 FROM lineitem GROUP BY l_suppkey),
s AS (SELECT l_suppkey, CAST(a0 + a1 + a2 AS DOUBLE) AS n1, CAST(b0 + b1 + b2 AS DOUBLE) AS n0, a1, a2, b1, b2 FROM t),
v AS (SELECT l_suppkey, a1 * n0 - b1 * n1 + 2 * (a2 * n0 - b2 * n1) AS t, n1 * n0 * ((n1 + n0) * (a1 + b1 + 4 * (a2 + b2)) - (a1 + b1 + 2 * (a2 + b2)) * (a1 + b1 + 2 * (a2 + b2))) / (n1 + n0) AS var FROM s)
SELECT l_suppkey, CASE WHEN var > 0 THEN round(t / sqrt(var), 6) END AS z FROM v""")
def armitage_trend(spark, sf):
    q, f = F.col("l_quantity"), F.col("l_linestatus") == "F"
    levels = [q <= 17, (q > 17) & (q <= 34), q > 34]
    t = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(*[F.count_if(f & c).alias(f"a{i}") for i, c in enumerate(levels)], *[F.count_if(~f & c).alias(f"b{i}") for i, c in enumerate(levels)])
    return t.select("l_suppkey", F.round(popgen.armitage_z([F.col(f"a{i}") for i in range(3)], [F.col(f"b{i}") for i in range(3)], [0.0, 1.0, 2.0]), 6).alias("z"))


@query("""WITH c AS (SELECT l_partkey, count(*) FILTER (l_returnflag <> 'R') AS ref, count(*) FILTER (l_returnflag = 'R') AS alt FROM lineitem GROUP BY l_partkey),
w AS (SELECT l_partkey, exp(2 * ln(0.75) + alt * ln(0.01) + ref * ln(0.99)) AS aa, exp(ln(2 * 0.25 * 0.75) + (alt + ref) * ln(0.5)) AS ab, exp(2 * ln(0.25) + alt * ln(0.99) + ref * ln(0.01)) AS bb FROM c)
SELECT l_partkey, round(aa / (aa + ab + bb), 6) AS p_aa, round(ab / (aa + ab + bb), 6) AS p_ab, round(bb / (aa + ab + bb), 6) AS p_bb FROM w""")
def genotype_posterior(spark, sf):
    r = F.col("l_returnflag") == "R"
    c = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_if(~r).alias("ref"), F.count_if(r).alias("alt"))
    p = popgen.genotype_posterior(F.col("ref"), F.col("alt"), F.lit(0.25))
    return c.select("l_partkey", *[F.round(x, 6).alias(n) for x, n in zip(p, ("p_aa", "p_ab", "p_bb"), strict=True)])


@query("""WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, pos // 86400 ORDER BY abs(2 * pos - (2 * (pos // 86400) + 1) * 86400), pos, event_id) AS k FROM e) SELECT user_id, event_id, pos FROM r WHERE k = 1""")
def thin_by_bin(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"))
    return popgen.thin(e, ["user_id"], "pos", "event_id", 86400).select("user_id", "event_id", "pos")


@query()
def hash_sample(spark, sf):
    """A sampling operator: about a tenth of the orders."""
    return popgen.hash_sample(read(spark, sf, "orders"), "o_orderkey", 0.1, 7).select("o_orderkey")
