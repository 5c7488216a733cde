"""Rules, aggregates, joins, sets and statistics on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, stats
from ..operators import aggregates as ag
from ..operators import rules, sets
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


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_quantity >= 30 THEN 'PASS' WHEN l_quantity >= 20 AND l_discount <= 0.05 THEN 'RESCUE_STRONG'
 WHEN l_quantity >= 10 AND l_tax <= 0.04 THEN 'RESCUE_RELAXED' ELSE 'PENDING' END AS label FROM lineitem""")
def rule_cascade(spark, sf):
    q, c = F.col("l_quantity"), F.col
    label = rules.first_match([((c("l_returnflag") == "N") & (q >= 30), "PASS"), ((q >= 20) & (c("l_discount") <= 0.05), "RESCUE_STRONG"), ((q >= 10) & (c("l_tax") <= 0.04), "RESCUE_RELAXED")], "PENDING")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice >= 1500 THEN 'A' WHEN p_retailprice >= 1200 THEN 'B' WHEN p_retailprice >= 1000 THEN 'C' ELSE 'D' END AS priority,
 CASE WHEN p_size <= 5 THEN 'micro' WHEN p_size <= 20 THEN 'small' WHEN p_size <= 40 THEN 'medium' ELSE 'large' END AS size_class FROM part""")
def threshold_ladders(spark, sf):
    return read(spark, sf, "part").select("p_partkey", rules.ladder(F.col("p_retailprice"), [(1500, "A"), (1200, "B"), (1000, "C")], "D").alias("priority"), rules.below(F.col("p_size"), [(5, "micro"), (20, "small"), (40, "medium")], "large").alias("size_class"))


_GT = "CASE WHEN l_returnflag = 'A' THEN '0/0' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN '0/1' WHEN l_returnflag = 'R' THEN '1|1' ELSE './.' END"


def genotypes(spark, sf):
    c = F.col
    gt = rules.first_match([(c("l_returnflag") == "A", "0/0"), ((c("l_returnflag") == "N") & (c("l_linestatus") == "O"), "0/1"), (c("l_returnflag") == "R", "1|1")], "./.")
    return read(spark, sf, "lineitem").withColumn("gt", gt).withColumn("class", rules.genotype_class(c("gt")))


@query(f"""WITH g AS (SELECT *, {_GT} AS gt FROM lineitem), k AS (SELECT l_suppkey, CASE gt WHEN '0/0' THEN 'HOM_REF' WHEN '0/1' THEN 'HET' WHEN '1|1' THEN 'HOM_VAR' ELSE 'OTHER' END AS class FROM g)
SELECT l_suppkey, count(*) FILTER (class = 'HOM_REF') AS n_hom_ref, count(*) FILTER (class = 'HET') AS n_het, count(*) FILTER (class = 'HOM_VAR') AS n_hom_var, count(*) FILTER (class = 'OTHER') AS n_other FROM k GROUP BY l_suppkey""")
def genotype_class_counts(spark, sf):
    c = F.col("class")
    return genotypes(spark, sf).groupBy("l_suppkey").agg(*ag.count_where({"n_hom_ref": c == "HOM_REF", "n_het": c == "HET", "n_hom_var": c == "HOM_VAR", "n_other": c == "OTHER"}))


@query("""WITH b AS (SELECT l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_suppkey) AS k FROM lineitem),
a AS (SELECT l_partkey, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_members, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY l_partkey)
SELECT a.*, b.l_suppkey AS representative FROM a JOIN b ON b.l_partkey = a.l_partkey AND k = 1""")
def catalog(spark, sf):
    return ag.catalog(read(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "l_extendedprice")


@query("""SELECT n_members, count(*) AS n_keys FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS n_members FROM lineitem GROUP BY l_partkey) GROUP BY n_members""")
def frequency_spectrum(spark, sf):
    return ag.spectrum(read(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("""SELECT p_brand, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (o_orderpriority LIKE '2%') AS high, count(*) FILTER (o_orderpriority LIKE '3%') AS medium
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY p_brand""")
def pivot_matrix(spark, sf):
    j = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p")), F.col("o_orderkey") == F.col("l_orderkey"))
    j = j.join(read(spark, sf, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    t = j.groupBy("p_brand").pivot("p", ["1", "2", "3"]).agg(F.count(F.lit(1)))
    return t.select("p_brand", *[F.coalesce(k, F.lit(0)).alias(v) for k, v in (("1", "urgent"), ("2", "high"), ("3", "medium"))])


@query("""SELECT p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 6) AS weighted, round(stddev_samp(p_retailprice) / avg(p_retailprice), 9) AS cv, round(quantile_cont(p_retailprice, 0.25), 6) AS q25,
 round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.75), 6) AS q75 FROM part GROUP BY p_brand""")
def weighted_and_quantile_statistics(spark, sf):
    pct = lambda q: F.round(F.expr(f"percentile(p_retailprice, {q})"), 6)
    return read(spark, sf, "part").groupBy("p_brand").agg(F.round(ag.weighted_mean(F.col("p_retailprice"), F.col("p_size")), 6).alias("weighted"), F.round(ag.variation("p_retailprice"), 9).alias("cv"), pct(0.25).alias("q25"), pct(0.5).alias("median"), pct(0.75).alias("q75"))


@query("""WITH e AS (SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS bin FROM events), g AS (SELECT event_type, unnest(range(min(bin), max(bin) + 1)) AS bin FROM e GROUP BY event_type)
SELECT g.event_type, g.bin, count(e.bin) AS n FROM g LEFT JOIN e ON e.event_type = g.event_type AND e.bin = g.bin GROUP BY g.event_type, g.bin""")
def dense_bins(spark, sf):
    return ag.dense_bins(read(spark, sf, "events"), "event_type", F.unix_seconds(F.col("ts").cast("timestamp")), 86400)


@query("""WITH s AS (SELECT user_id, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS pattern, count(DISTINCT event_type) AS n_items FROM events GROUP BY user_id)
SELECT pattern, n_items, count(*) AS n_keys FROM s GROUP BY pattern, n_items ORDER BY n_keys DESC, n_items, pattern LIMIT 20""")
def set_pattern_combinations(spark, sf):
    return ag.set_patterns(read(spark, sf, "events"), "user_id", "event_type", 20)


@query("""WITH r AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), k AS (SELECT l_partkey FROM r GROUP BY l_partkey HAVING count(*) BETWEEN 2 AND 25)
SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM r a JOIN r b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey WHERE a.l_partkey IN (SELECT l_partkey FROM k) GROUP BY 1, 2""")
def rare_sharing_pairs(spark, sf):
    return ag.pair_counts(read(spark, sf, "lineitem"), "l_partkey", "l_suppkey", 25)


@query("""WITH f AS (SELECT p_brand, min(p_size) AS p_size FROM part GROUP BY p_brand), r AS (SELECT p_size, count(DISTINCT f.p_brand) AS new FROM (SELECT DISTINCT p_size FROM part) LEFT JOIN f USING (p_size) GROUP BY p_size)
SELECT p_size, new, CAST(sum(new) OVER (ORDER BY p_size) AS BIGINT) AS cumulative FROM r""")
def cumulative_distinct(spark, sf):
    return ag.first_hits(read(spark, sf, "part"), "p_size", "p_brand")


_TABLE = """t AS (SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING' AND o_orderstatus = 'F') AS a, count(*) FILTER (c_mktsegment = 'BUILDING' AND o_orderstatus <> 'F') AS b,
 count(*) FILTER (c_mktsegment <> 'BUILDING' AND o_orderstatus = 'F') AS c, count(*) FILTER (c_mktsegment <> 'BUILDING' AND o_orderstatus <> 'F') AS d
 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey)"""


@query(f"""WITH {_TABLE}, x AS (SELECT *, a + b AS r1, a + c AS c1, a + b + c + d AS n, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS x FROM t),
l AS (SELECT *, lgamma(c1 + 1) - lgamma(x + 1) - lgamma(c1 - x + 1) + lgamma(n - c1 + 1) - lgamma(r1 - x + 1) - lgamma(n - c1 - r1 + x + 1) - (lgamma(n + 1) - lgamma(r1 + 1) - lgamma(n - r1 + 1)) AS lp FROM x),
s AS (SELECT c_nationkey, lp AS seen FROM l WHERE x = a)
SELECT l.c_nationkey, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, round(least(1.0, sum(CASE WHEN lp <= seen + 1e-12 THEN exp(lp) ELSE 0 END)), 6) AS p,
 round(any_value(CASE WHEN b * c > 0 THEN a * d / (b * c) END), 6) AS odds FROM l JOIN s USING (c_nationkey) GROUP BY l.c_nationkey""")
def fisher_exact(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    seg, fin = F.col("c_mktsegment") == "BUILDING", F.col("o_orderstatus") == "F"
    t = o.groupBy("c_nationkey").agg(*ag.count_where({"a": seg & fin, "b": seg & ~fin, "c": ~seg & fin, "d": ~seg & ~fin}))
    return stats.fisher_exact(t, "a", "b", "c", "d").select("c_nationkey", "a", "b", "c", "d", F.round("p", 6).alias("p"), F.round(stats.odds_ratio("a", "b", "c", "d"), 6).alias("odds"))


def _fisher_table(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    seg, fin = F.col("c_mktsegment") == "BUILDING", F.col("o_orderstatus") == "F"
    return o.groupBy("c_nationkey").agg(*ag.count_where({"a": seg & fin, "b": seg & ~fin, "c": ~seg & fin, "d": ~seg & ~fin}))


@query(f"""WITH {_TABLE}, x AS (SELECT *, a + b AS r1, a + c AS c1, a + b + c + d AS n, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS x FROM t),
l AS (SELECT *, exp(lgamma(c1 + 1) - lgamma(x + 1) - lgamma(c1 - x + 1) + lgamma(n - c1 + 1) - lgamma(r1 - x + 1) - lgamma(n - c1 - r1 + x + 1) - (lgamma(n + 1) - lgamma(r1 + 1) - lgamma(n - r1 + 1))) AS p FROM x)
SELECT c_nationkey, round(least(1.0, sum(p) FILTER (x >= a)), 6) AS p_greater, round(any_value((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))), 6) AS odds, round(any_value(exp(ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))) - 1.959963984540054 * sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5)))), 6) AS lower,
 round(any_value(exp(ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))) + 1.959963984540054 * sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5)))), 6) AS upper FROM l GROUP BY c_nationkey""")
def fisher_one_sided(spark, sf):
    t = stats.fisher_greater(_fisher_table(spark, sf), "a", "b", "c", "d").withColumn("w", stats.woolf_interval("a", "b", "c", "d"))
    return t.select("c_nationkey", F.round("p_greater", 6).alias("p_greater"), *[F.round(f"w.{k}", 6).alias(k) for k in ("odds", "lower", "upper")])


@query("""WITH r AS (SELECT DISTINCT o_orderpriority AS s, o_custkey AS m FROM orders), z AS (SELECT s, count(*) AS n FROM r GROUP BY s), k AS (SELECT a.s AS a, b.s AS b, count(*) AS shared FROM r a JOIN r b ON a.m = b.m AND a.s < b.s GROUP BY 1, 2)
SELECT x.s AS a, y.s AS b, x.n AS n_a, y.n AS n_b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)), 6) AS jaccard, CASE WHEN coalesce(shared, 0) = 0 THEN 'DISJOINT' WHEN shared = x.n AND shared = y.n THEN 'IDENTICAL' WHEN shared = x.n OR shared = y.n THEN 'NESTED' ELSE 'OVERLAPPING' END AS relation FROM z x JOIN z y ON x.s < y.s LEFT JOIN k ON k.a = x.s AND k.b = y.s""")
def compare_sets(spark, sf):
    out = sets.compare_all(read(spark, sf, "orders"), "o_orderpriority", "o_custkey", 1500)
    return out.select("a", "b", "n_a", "n_b", "shared", F.round("jaccard", 6).alias("jaccard"), "relation")


@query("""WITH t AS (SELECT c_mktsegment AS x, o_orderpriority AS y, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
xs AS (SELECT x, sum(n) AS nx FROM t GROUP BY x), ys AS (SELECT y, sum(n) AS ny FROM t GROUP BY y), tot AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM t),
c AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n / total * ln(n * total / (nx * ny))) AS mi, sum(n * n / (nx * ny / total)) AS q, max(total) AS total FROM t JOIN xs USING (x) JOIN ys USING (y), tot),
a AS (SELECT sum(nx * (nx - 1) / 2.0) AS s1, sum(-nx / total * ln(nx / total)) AS h1, count(*) AS k1 FROM xs, tot), b AS (SELECT sum(ny * (ny - 1) / 2.0) AS s2, sum(-ny / total * ln(ny / total)) AS h2, count(*) AS k2 FROM ys, tot)
SELECT round((s - s1 * s2 / (total * (total - 1) / 2)) / ((s1 + s2) / 2 - s1 * s2 / (total * (total - 1) / 2)), 9) AS ari, round(2 * mi / (h1 + h2), 9) AS nmi, round(sqrt((q - total) / (total * (least(k1, k2) - 1))), 9) AS cramer_v FROM c, a, b""")
def label_agreement(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return stats.agreement(o, "c_mktsegment", "o_orderpriority").select(*[F.round(c, 9).alias(c) for c in ("ari", "nmi", "cramer_v")])


@query("""WITH p AS (SELECT l_partkey, count(*) FILTER (l_linestatus = 'O') AS n1, count(*) FILTER (l_linestatus = 'F') AS n2, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) FILTER (l_linestatus = 'O') AS p1,
 avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) FILTER (l_linestatus = 'F') AS p2 FROM lineitem GROUP BY l_partkey),
t AS (SELECT l_partkey // 50 AS block, (p1 - p2) * (p1 - p2) - p1 * (1 - p1) / (n1 - 1) - p2 * (1 - p2) / (n2 - 1) AS num, p1 * (1 - p2) + p2 * (1 - p1) AS den FROM p WHERE n1 > 1 AND n2 > 1)
SELECT block, count(*) AS n, round(CASE WHEN sum(den) > 0 THEN greatest(0, least(1, sum(num) / sum(den))) END, 6) AS fst FROM t GROUP BY block""")
def windowed_ratio_of_sums(spark, sf):
    ret, o = (F.col("l_returnflag") == "R").cast("double"), F.col("l_linestatus")
    p = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_if(o == "O").alias("n1"), F.count_if(o == "F").alias("n2"), F.avg(F.when(o == "O", ret)).alias("p1"), F.avg(F.when(o == "F", ret)).alias("p2")).where("n1 > 1 and n2 > 1")
    num, den = scalars.hudson_terms(F.col("p1"), F.col("n1"), F.col("p2"), F.col("n2"))
    t = p.groupBy(F.floor(F.col("l_partkey") / 50).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sum(num).alias("num"), F.sum(den).alias("den"))
    return t.select("block", "n", F.round(F.when(F.col("den") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("num") / F.col("den")))), 6).alias("fst"))


@query("""SELECT coalesce(c.n, s.n) AS n_name, coalesce(c.k, 0) AS customers, coalesce(s.k, 0) AS suppliers FROM (SELECT n_name AS n, count(*) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000 GROUP BY 1) c
FULL JOIN (SELECT n_name AS n, count(*) AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1) s ON c.n = s.n""")
def full_outer_zero_fill(spark, sf):
    n = F.broadcast(read(spark, sf, "nation").select("n_nationkey", "n_name"))  # a table of fixed size
    c = read(spark, sf, "customer").where("c_acctbal > 9000").join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))
    s = read(spark, sf, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "n_name", "full_outer").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def semi_and_anti_join(spark, sf):
    o = read(spark, sf, "orders")
    c = read(spark, sf, "customer").select("c_custkey")
    kept = c.join(o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return kept.join(o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 0), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal < 0)
SELECT 'intersect' AS op, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'union', k FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def set_operations(spark, sf):
    a = read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).distinct()
    b = read(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("k")).distinct()
    tag = lambda op, d: d.select(F.lit(op).alias("op"), "k")
    return tag("intersect", a.intersect(b)).unionByName(tag("except", a.subtract(b))).unionByName(tag("union", a.union(b).distinct()))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name, c_mktsegment), (r_name), ())""")
def grouping_sets(spark, sf):
    for t in ("customer", "nation", "region"):
        read(spark, sf, t).createOrReplaceTempView(f"gs_{t}")
    return spark.sql("SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM gs_customer JOIN gs_nation ON n_nationkey = c_nationkey JOIN gs_region ON r_regionkey = n_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name, c_mktsegment), (r_name), ())")


@query("""SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY user_id, event_type) WHERE k = 1""")
def majority_label(spark, sf):
    c = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("user_id").agg(F.max("n").alias("n"))
    return c.join(best, ["user_id", "n"]).groupBy("user_id", "n").agg(F.min("event_type").alias("event_type")).select("user_id", "event_type", "n")


@query("""WITH s AS (SELECT o_custkey, sum(o_totalprice) AS w FROM orders GROUP BY o_custkey), g AS (SELECT c_nationkey, c_mktsegment, sum(w) AS w FROM s JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), t AS (SELECT c_nationkey, sum(w) AS t FROM g GROUP BY 1)
SELECT c_nationkey, round(sum(-(w / t) * ln(w / t)), 6) AS h, round(exp(sum(-(w / t) * ln(w / t))), 6) AS effective, round(max(w / t), 6) AS top FROM g JOIN t USING (c_nationkey) GROUP BY c_nationkey""")
def entropy_profile(spark, sf):
    g = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "c_mktsegment").agg(F.sum("o_totalprice").alias("w"))
    shares = g.groupBy("c_nationkey").agg(F.collect_list("w").alias("w"))  # at most the five segments
    p = shares.withColumn("p", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda s, y: s + y)))
    h = stats.entropy(F.col("p"))
    return p.select("c_nationkey", F.round(h, 6).alias("h"), F.round(F.exp(h), 6).alias("effective"), F.round(F.array_max("p"), 6).alias("top"))
