"""Rank tests, pairs within reach and label comparisons on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import comparisons
from ..operators import clusters, distances
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


_RANKED = """r AS (SELECT p_brand, p_size, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS x,
 count(*) OVER (PARTITION BY p_brand, p_retailprice) AS c FROM part)"""


@query(f"""WITH {_RANKED}, s AS (SELECT p_brand, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (p_size > 25) AS DOUBLE) AS n1, coalesce(sum(x) FILTER (p_size > 25), 0) AS r1, sum(CAST(c * c - 1 AS DOUBLE)) AS ties FROM r GROUP BY p_brand),
v AS (SELECT *, n - n1 AS n0, r1 - n1 * (n1 + 1) / 2 AS u FROM s), w AS (SELECT *, u - n1 * n0 / 2 AS d, n1 * n0 / 12 * (n + 1 - ties / nullif(n * (n - 1), 0)) AS var FROM v)
SELECT p_brand, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, CAST(u AS DOUBLE) AS u, CASE WHEN var > 0 THEN round((d - sign(d) * 0.5) / sqrt(var), 6) END AS z FROM w""")
def mann_whitney(spark, sf):
    p = read(spark, sf, "part").withColumn("big", F.col("p_size") > 25)
    return comparisons.mann_whitney(p, ["p_brand"], "big", "p_retailprice").withColumn("z", F.round("z", 6))


@query(f"""WITH {_RANKED}, g AS (SELECT p_brand, p_size % 5 AS k, sum(x) * sum(x) / count(*) AS s FROM r GROUP BY ALL),
t AS (SELECT p_brand, CAST(count(*) AS DOUBLE) AS n, sum(CAST(c * c - 1 AS DOUBLE)) AS ties FROM r GROUP BY p_brand)
SELECT p_brand, CAST(n AS BIGINT) AS n, count(*) - 1 AS freedom, CASE WHEN count(*) > 1 THEN round((12 / (n * (n + 1)) * sum(s) - 3 * (n + 1)) / nullif(1 - ties / nullif(n * n * n - n, 0), 0), 6) END AS h
FROM g JOIN t USING (p_brand) GROUP BY p_brand, n, ties""")
def kruskal_wallis(spark, sf):
    p = read(spark, sf, "part").withColumn("k", F.col("p_size") % 5)
    return comparisons.kruskal(p, ["p_brand"], "k", "p_retailprice").withColumn("h", F.round("h", 6))


@query("""WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) / count(*) OVER (PARTITION BY p_brand) AS y, count(*) OVER (PARTITION BY p_brand) AS n,
 (p_retailprice - min(p_retailprice) OVER (PARTITION BY p_brand)) / nullif(max(p_retailprice) OVER (PARTITION BY p_brand) - min(p_retailprice) OVER (PARTITION BY p_brand), 0) AS e FROM part),
g AS (SELECT p_brand, any_value(n) AS n, max(abs(y - e)) AS gap FROM r GROUP BY p_brand)
SELECT p_brand, n, round(gap, 6) AS gap, CASE WHEN n < 10 OR gap IS NULL THEN 1 ELSE round(least(1, 2 * exp(-2 * gap * gap * n)), 6) END AS score FROM g""")
def ecdf_deviation(spark, sf):
    return comparisons.ecdf_deviation(read(spark, sf, "part"), ["p_brand"], "p_retailprice").withColumn("gap", F.round("gap", 6)).withColumn("score", F.round("score", 6))


@query("""WITH g AS (SELECT p_brand, p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS gap FROM part),
m AS (SELECT p_brand, median(gap) AS m FROM g GROUP BY p_brand) SELECT p_brand, CAST(least(5, 1 + count(*) FILTER (gap > 2 * m)) AS INTEGER) AS n_clusters FROM g JOIN m USING (p_brand) GROUP BY p_brand""")
def gap_clusters(spark, sf):
    return comparisons.gap_count(read(spark, sf, "part"), ["p_brand"], "p_retailprice")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
z AS (SELECT vec_id, list_transform(v, lambda x: (x - list_aggregate(v, 'avg')) / list_aggregate(v, 'stddev_pop')) AS z FROM e)
SELECT a.vec_id AS a, b.vec_id AS b, round(power(list_dot_product(a.z, b.z) / len(a.z), 2), 6) AS r2 FROM z a JOIN z b ON b.vec_id > a.vec_id AND b.vec_id - a.vec_id <= 5""")
def linkage_r2_within_reach(spark, sf):
    e = read(spark, sf, "embeddings").where("embedding is not null")
    return comparisons.linkage_r2(e, [], "vec_id", "vec_id", "embedding", 5).select("a", "b", F.round("r2", 6).alias("r2"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL)
SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(1 - list_aggregate(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2])), 'avg') / 2, 6) AS similarity FROM e a JOIN e b ON a.label = b.label AND b.vec_id > a.vec_id AND b.vec_id - a.vec_id <= 40""")
def dosage_similarity_within_reach(spark, sf):
    e = read(spark, sf, "embeddings").where("embedding is not null")
    return comparisons.dosage_similarity(e, ["label"], "vec_id", "vec_id", "embedding", 40).withColumn("similarity", F.round("similarity", 6))


@query("""WITH t AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS c FROM lineitem GROUP BY ALL),
m AS (SELECT l_suppkey, c, sum(c) OVER (PARTITION BY l_suppkey, l_returnflag) AS x, sum(c) OVER (PARTITION BY l_suppkey, l_linestatus) AS y, sum(c) OVER (PARTITION BY l_suppkey) AS n FROM t)
SELECT l_suppkey, CAST(any_value(n) AS BIGINT) AS n, CASE WHEN any_value(n) >= 4 THEN round(sum(c / n * log2(c * n / (x * y))), 6) + 0.0 END AS bits FROM m GROUP BY l_suppkey""")
def mutual_information(spark, sf):
    return comparisons.mutual_information(read(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag", "l_linestatus").withColumn("bits", F.round("bits", 6) + 0.0)


@query("""WITH t AS (SELECT o_custkey AS fine, o_orderstatus AS coarse, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY fine) AS share FROM t)
SELECT coarse, count(*) AS n_fine FROM s WHERE share >= 0.8 GROUP BY coarse HAVING count(*) >= 2""")
def fuse_events(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("fine"), F.col("o_orderstatus").alias("coarse"))
    return comparisons.fuse_events(o, "fine", "coarse")


@query("""WITH t AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM t)
SELECT c_nationkey, c_mktsegment AS parent, count(*) OVER (PARTITION BY c_mktsegment) > 1 AS merges FROM r WHERE k = 1""")
def plurality_parent(spark, sf):
    return comparisons.plurality_parent(read(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


@query("""WITH p AS (SELECT l_linenumber AS s, l_suppkey % 2 AS b, l_returnflag AS g, count(*) FILTER (l_linestatus = 'F') AS a, count(*) AS t FROM lineitem GROUP BY ALL),
x AS (SELECT DISTINCT g AS out FROM p UNION ALL SELECT NULL),
c AS (SELECT x.out, s, CAST(sum(a) FILTER (b = 0) AS DOUBLE) AS a0, CAST(sum(t) FILTER (b = 0) AS DOUBLE) AS t0, CAST(sum(a) FILTER (b = 1) AS DOUBLE) AS a1, CAST(sum(t) FILTER (b = 1) AS DOUBLE) AS t1 FROM x JOIN p ON x.out IS DISTINCT FROM p.g GROUP BY ALL),
f AS (SELECT out, a0 / t0 AS p, t0 AS n, a1 / t1 AS q, t1 AS m FROM c WHERE t0 >= 2 AND t1 >= 2)
SELECT out AS l_returnflag, round(sum((p - q) * (p - q) - p * (1 - p) / (n - 1) - q * (1 - q) / (m - 1)) / nullif(sum(p * (1 - q) + q * (1 - p)), 0), 6) + 0.0 AS fst FROM f GROUP BY out""")
def leave_one_group_out(spark, sf):
    one = read(spark, sf, "lineitem").select("l_linenumber", (F.col("l_suppkey") % 2).alias("band"), "l_returnflag", (F.col("l_linestatus") == "F").cast("long").alias("alt"), F.lit(1).alias("total"))
    return comparisons.leave_one_out_fst(one, "l_linenumber", "band", "l_returnflag", "alt", "total").withColumn("fst", F.round("fst", 6) + 0.0)


@query()
def adaptive_clusters(spark, sf):
    return clusters.adaptive_k(read(spark, sf, "part"), "p_brand", "p_partkey", "p_retailprice")


@query()
def gaussian_mixture(spark, sf):
    return clusters.gaussian_mixture_1d(read(spark, sf, "part"), "p_brand", "p_partkey", "p_retailprice")


@query()
def plane_clusters(spark, sf):
    return clusters.kmeans_2d(read(spark, sf, "part"), "p_brand", "p_partkey", "p_size", "p_retailprice")


@query()
def density_clusters(spark, sf):
    p = read(spark, sf, "part").withColumn("y", F.col("p_retailprice") / 40)
    return clusters.density_clusters(p, "p_brand", "p_partkey", "p_size", "y")


@query()
def average_linkage(spark, sf):
    return clusters.average_linkage(read(spark, sf, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal", 3)


@query()
def theil_sen(spark, sf):
    return clusters.theil_sen(read(spark, sf, "part"), "p_brand", "p_size", "p_retailprice")


@query()
def half_sample_mode(spark, sf):
    return clusters.half_sample_mode(read(spark, sf, "part"), "p_brand", "p_retailprice")


@query("""WITH l AS (SELECT p_brand, p_size % 3 AS a, p_partkey % 3 AS b FROM part), t AS (SELECT p_brand, a, b, count(*) AS n FROM l GROUP BY ALL),
m AS (SELECT * FROM (VALUES (0, 0, 1, 2), (1, 0, 2, 1), (2, 1, 0, 2), (3, 1, 2, 0), (4, 2, 0, 1), (5, 2, 1, 0)) v(id, x0, x1, x2)),
s AS (SELECT p_brand, id, x0, x1, x2, coalesce(sum(n) FILTER (b = CASE a WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END), 0) AS kept, sum(n) AS total FROM t, m GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY kept DESC, x0, x1, x2) AS r FROM s)
SELECT p_brand, kept / total AS agreement FROM k WHERE r = 1""")
def label_alignment(spark, sf):
    p = read(spark, sf, "part").select("p_brand", (F.col("p_size") % 3).cast("int").alias("a"), (F.col("p_partkey") % 3).cast("int").alias("b"))
    return clusters.align_labels(p, "p_brand", "a", "b", 3).select("p_brand", "agreement")


@query("""WITH p AS (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL), g AS (SELECT DISTINCT o_orderpriority, o_orderstatus FROM p),
k AS (SELECT x.o_orderpriority, x.o_orderstatus AS a, y.o_orderstatus AS b FROM g x JOIN g y ON x.o_orderpriority = y.o_orderpriority AND x.o_orderstatus < y.o_orderstatus),
r AS (SELECT k.*, o_orderstatus = a AS one, rank() OVER w + (count(*) OVER (PARTITION BY k.o_orderpriority, a, b, o_totalprice) - 1) / 2 AS x, count(*) OVER (PARTITION BY k.o_orderpriority, a, b, o_totalprice) AS c
      FROM k JOIN p ON p.o_orderpriority = k.o_orderpriority AND p.o_orderstatus IN (a, b) WINDOW w AS (PARTITION BY k.o_orderpriority, a, b ORDER BY o_totalprice)),
s AS (SELECT o_orderpriority, a, b, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (one) AS DOUBLE) AS m, sum(x) FILTER (one) AS t, sum(CAST(c * c - 1 AS DOUBLE)) AS ties FROM r GROUP BY o_orderpriority, a, b),
v AS (SELECT *, t - m * (m + 1) / 2 AS u, m * (n - m) / 12 * (n + 1 - ties / (n * (n - 1))) AS var FROM s)
SELECT o_orderpriority, a, b, CAST(m AS BIGINT) AS n1, CAST(n - m AS BIGINT) AS n0, u, CASE WHEN var > 0 THEN round((u - m * (n - m) / 2 - sign(u - m * (n - m) / 2) * 0.5) / sqrt(var), 9) END AS z FROM v""")
def pairwise_rank_tests(spark, sf):
    t = comparisons.pairwise_ranks(read(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice")
    return t.select("o_orderpriority", "a", "b", "n1", "n0", "u", F.round("z", 9).alias("z"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS k FROM customer GROUP BY 1, 2), s AS (SELECT DISTINCT c_mktsegment FROM customer),
v AS (SELECT n_regionkey, n_nationkey, s.c_mktsegment, coalesce(k, 1) AS k FROM nation CROSS JOIN s LEFT JOIN c ON c_nationkey = n_nationkey AND c.c_mktsegment = s.c_mktsegment)
SELECT x.n_regionkey, x.n_nationkey AS a, y.n_nationkey AS b, round(avg(abs(x.k - y.k)), 9) AS distance FROM v x JOIN v y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey AND x.c_mktsegment = y.c_mktsegment GROUP BY 1, 2, 3""")
def dosage_distances(spark, sf):
    """Nations of a region by their customers a segment."""
    c = read(spark, sf, "customer")
    names = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # the segments, five by the schema
    counts = c.groupBy("c_nationkey").pivot("c_mktsegment", names).count()
    v = read(spark, sf, "nation").join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_regionkey", "n_nationkey", F.array(*[F.col(f"`{n}`") for n in names]).alias("v"))
    return distances.dosage_distance(v, "n_regionkey", "n_nationkey", "v").withColumn("distance", F.round("distance", 9))


@query()
def local_structure_distances(spark, sf):
    """Embedding dimensions as samples, labels as windows."""
    windows = distances.window_eigen(read(spark, sf, "embeddings"), "label", "embedding")
    return distances.local_structure_distance(windows.withColumn("k", F.lit(1)), "k", "label").drop("k")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT user_id, CAST(sum(n) AS DOUBLE) AS weight FROM c GROUP BY 1),
p AS (SELECT x.event_type AS a, y.event_type AS b, weight, (x.n >= 3) = (y.n >= 3) AS one FROM c x JOIN c y ON x.user_id = y.user_id AND x.event_type < y.event_type JOIN w ON w.user_id = x.user_id),
s AS (SELECT a, b, coalesce(sum(weight) FILTER (one), 0) AS together, coalesce(sum(weight) FILTER (NOT one), 0) AS apart FROM p GROUP BY a, b)
SELECT a, b, together, apart, together / (together + apart) AS share FROM s""")
def co_association(spark, sf):
    """A user votes for the event types they have three times or more, against those they have less often."""
    c = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    held = lambda often: F.collect_list(F.when((F.col("n") >= 3) == often, F.col("event_type")))
    votes = c.groupBy("user_id").agg(F.sum("n").cast("double").alias("weight"), held(F.lit(True)).alias("visited"), held(F.lit(False)).alias("excluded"))
    return comparisons.co_association(votes, [], "weight", "visited", "excluded")


@query()
def trajectory_clusters(spark, sf):
    """Nations of a region by their customers a segment."""
    c = read(spark, sf, "customer")
    names = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # the segments, five by the schema
    counts = c.groupBy("c_nationkey").pivot("c_mktsegment", names).count()
    v = read(spark, sf, "nation").join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_regionkey", "n_nationkey", F.array(*[F.col(f"`{n}`") for n in names]).alias("v"))
    return clusters.trajectory_clusters(v, "n_regionkey", "n_nationkey", "v", k=2)
