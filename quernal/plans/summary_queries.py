"""Summaries on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as sm
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


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("""SELECT l_shipmode_zone AS zone, l_returnflag, count(*) AS n, count(*) FILTER (l_discount < 0.05) AS n_significant FROM (SELECT *, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 40 THEN 'mid' ELSE 'high' END AS l_shipmode_zone FROM lineitem) GROUP BY ALL""")
def significant_by_zone(spark, sf):
    q = F.col("l_quantity")
    zoned = read(spark, sf, "lineitem").withColumn("zone", F.when(q < 10, "low").when(q < 40, "mid").otherwise("high"))
    return sm.significant_counts(zoned, ["zone", "l_returnflag"], F.col("l_discount"))


@query("""SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ';' ORDER BY CAST(l_suppkey AS VARCHAR)) AS members, count(DISTINCT l_suppkey) AS n_members FROM lineitem GROUP BY l_orderkey""")
def members_of_orders(spark, sf):
    return sm.joined_members(read(spark, sf, "lineitem"), ["l_orderkey"], "l_suppkey")


@query("""WITH t AS (SELECT unnest(string_split(p_type, ' ')) AS term, CASE p_brand WHEN 'Brand#11' THEN 0 WHEN 'Brand#12' THEN 1 WHEN 'Brand#13' THEN 2 ELSE 3 END AS rank, p_size FROM part)
SELECT term, count(*) AS n, CASE min(rank) WHEN 0 THEN 'Brand#11' WHEN 1 THEN 'Brand#12' WHEN 2 THEN 'Brand#13' END AS kind, count(DISTINCT p_size) AS n_places FROM t WHERE term <> '' GROUP BY term""")
def collapse_types(spark, sf):
    return sm.collapse_terms(read(spark, sf, "part"), "p_type", "p_brand", ["Brand#11", "Brand#12", "Brand#13"], "p_size", " ")


@query("""SELECT l_suppkey, l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bp, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) / 100000 AS share FROM lineitem GROUP BY ALL""")
def covered_share_by_supplier(spark, sf):
    return sm.covered_share(read(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], F.col("l_quantity").cast("long"), 100_000)


@query("""SELECT l_suppkey, count(*) FILTER (l_quantity > 25) AS n_inside, count(*) FILTER (l_quantity <= 25) AS n_outside, round(avg(l_extendedprice) FILTER (l_quantity > 25), 4) AS inside, round(avg(l_extendedprice) FILTER (l_quantity <= 25), 4) AS outside FROM lineitem GROUP BY l_suppkey""")
def inside_and_outside_means(spark, sf):
    return rounded(sm.inside_outside(read(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", F.col("l_quantity"), F.lit(50)), "inside", "outside", digits=4)


@query("""SELECT l_suppkey, CAST(coalesce(sum(q) FILTER (q >= 1 AND q < 8), 0) AS BIGINT) AS bin_0, CAST(coalesce(sum(q) FILTER (q >= 8 AND q < 16), 0) AS BIGINT) AS bin_1, CAST(coalesce(sum(q) FILTER (q >= 16 AND q < 50), 0) AS BIGINT) AS bin_2, CAST(coalesce(sum(q) FILTER (q >= 50), 0) AS BIGINT) AS bin_3 FROM (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_suppkey""")
def length_bins_by_supplier(spark, sf):
    return sm.length_bins(read(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_quantity").cast("long"), [1, 8, 16, 50])


@query("""WITH m AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, count(m) AS n, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(quantile_cont(m, 0.25), 6) AS q25, round(quantile_cont(m, 0.75), 6) AS q75 FROM m GROUP BY l_returnflag""")
def summary_of_supplier_means(spark, sf):
    return rounded(sm.summary_of_means(read(spark, sf, "lineitem"), ["l_returnflag"], ["l_suppkey"], "l_quantity"), "mean", "median", "q25", "q75")


@query("""SELECT l_suppkey, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS "mean_A", round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS "mean_N", round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS "mean_R" FROM lineitem GROUP BY l_suppkey""")
def zone_means(spark, sf):
    means = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(*sm.means_by(F.col("l_quantity"), F.col("l_returnflag"), ["A", "N", "R"]))
    return rounded(means, "mean_A", "mean_N", "mean_R")


@query("""SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr, round(min(o_totalprice), 4) AS least, round(max(o_totalprice), 4) AS most FROM orders GROUP BY o_orderpriority""")
def spread_by_priority(spark, sf):
    return rounded(read(spark, sf, "orders").groupBy("o_orderpriority").agg(*sm.spread_summary("o_totalprice")), "mean", "median", "sd", "iqr", "least", "most", digits=4)


_SITES = """s AS (SELECT l_partkey, count(*) FILTER (l_linestatus = 'F') AS n1, count(*) FILTER (l_linestatus = 'O') AS n2, count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25) AS k1, count(*) FILTER (l_linestatus = 'O' AND l_quantity > 25) AS k2 FROM lineitem GROUP BY l_partkey),
p AS (SELECT l_partkey, l_partkey // 50 AS win, n1, n2, k1 / nullif(n1, 0) AS p1, k2 / nullif(n2, 0) AS p2 FROM s)"""


def _sites(spark, sf):
    f, o, big = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O", F.col("l_quantity") > 25
    s = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_if(f).alias("n1"), F.count_if(o).alias("n2"), F.count_if(f & big).alias("k1"), F.count_if(o & big).alias("k2"))
    return s.select("l_partkey", F.floor(F.col("l_partkey") / 50).alias("win"), "n1", "n2", F.try_divide("k1", "n1").alias("p1"), F.try_divide("k2", "n2").alias("p2"))


@query(f"""WITH {_SITES}, t AS (SELECT *, p1 * (1 - p2) + p2 * (1 - p1) AS d, (p1 - p2) * (p1 - p2) - p1 * (1 - p1) / nullif(n1 - 1, 0) - p2 * (1 - p2) / nullif(n2 - 1, 0) AS num FROM p)
SELECT win, count(*) AS n_sites, round(avg(2 * p1 * (1 - p1)), 6) AS pi1, round(avg(2 * p2 * (1 - p2)), 6) AS pi2, round(avg(d), 6) AS dxy, round(avg(abs(p1 - p2)), 6) AS delta, round(greatest(0.0, least(1.0, sum(num) / nullif(sum(d), 0))), 6) AS fst,
 count(*) FILTER (p1 > 0 AND p2 = 0) AS private1, count(*) FILTER (p2 > 0 AND p1 = 0) AS private2, count(*) FILTER ((p1 = 1 AND p2 = 0) OR (p1 = 0 AND p2 = 1)) AS fixed, count(*) FILTER (p1 > 0 AND p1 < 1 AND p2 > 0 AND p2 < 1) AS shared FROM t GROUP BY win""")
def window_diversity(spark, sf):
    c = F.col
    return rounded(sm.window_diversity(_sites(spark, sf), ["win"], c("p1"), c("n1"), c("p2"), c("n2")), "pi1", "pi2", "dxy", "delta", "fst")


@query(f"""WITH {_SITES} SELECT l_partkey, round((p1 - p2) * (p1 - p2) / nullif(p1 * (1 - p2) + p2 * (1 - p1), 0), 6) AS fst, round(p2 / nullif(2 * p1 * (1 - p1), 0), 6) AS h_over_e FROM p""")
def site_ratios(spark, sf):
    c = F.col
    return _sites(spark, sf).select("l_partkey", F.round(sm.uncorrected_fst(c("p1"), c("p2")), 6).alias("fst"), F.round(sm.heterozygosity_ratio(c("p2"), c("p1")), 6).alias("h_over_e"))


@query("""SELECT CAST(least(l_partkey // 200, l_suppkey // 10) AS BIGINT) AS bin1, CAST(greatest(l_partkey // 200, l_suppkey // 10) AS BIGINT) AS bin2, round(avg(l_discount), 8) AS mean, count(l_discount) AS n FROM lineitem GROUP BY ALL""")
def pair_bin_means(spark, sf):
    return rounded(sm.pair_bins(read(spark, sf, "lineitem"), F.col("l_partkey"), F.col("l_suppkey") * 20, 200, "l_discount"), "mean", digits=8)


@query("""WITH r AS (SELECT DISTINCT l_shipdate_m AS term, l_partkey, l_partkey % 10 = 0 AS hit FROM (SELECT *, CAST(month(l_shipdate) AS INTEGER) AS l_shipdate_m FROM lineitem)), t AS (SELECT count(*) FILTER (hit) AS n_target, count(*) FILTER (NOT hit) AS n_background FROM (SELECT DISTINCT l_partkey, hit FROM r))
SELECT term, count(*) FILTER (hit) AS k_target, count(*) FILTER (NOT hit) AS k_background, any_value(n_target) AS n_target, any_value(n_background) AS n_background FROM r, t GROUP BY term""")
def enrichment_counts(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.month("l_shipdate").alias("term"), "l_partkey")
    return sm.enrichment_counts(rows, "term", "l_partkey", F.col("l_partkey") % 10 == 0)


@query("""WITH p AS (SELECT l_returnflag, l_suppkey, count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY ALL) SELECT l_returnflag, count(*) AS n_inner, CAST(sum(k) AS BIGINT) AS n_items, count(*) FILTER (k >= 150) AS n_recurrent FROM p GROUP BY l_returnflag""")
def two_level_counts(spark, sf):
    return sm.two_level_counts(read(spark, sf, "lineitem"), "l_returnflag", "l_suppkey", "l_partkey", 150)


_FREQUENCIES = """r AS (SELECT l_partkey AS item, l_linenumber AS grp, l_suppkey AS member FROM lineitem), z AS (SELECT grp, count(DISTINCT member) AS size FROM r GROUP BY grp),
f AS (SELECT item, r.grp, count(DISTINCT member) AS carriers, count(DISTINCT member) / any_value(size) AS frequency FROM r JOIN z ON z.grp = r.grp GROUP BY item, r.grp)"""


def _frequencies(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("grp"), F.col("l_suppkey").alias("member"))
    return sm.group_frequencies(rows, "item", "grp", "member")


@query(f"""WITH {_FREQUENCIES}, b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY frequency DESC, grp) AS k FROM f)
SELECT item, CAST(sum(carriers) AS BIGINT) AS carriers, count(*) AS n_groups, max(grp) FILTER (k = 1) AS top_group, round(max(frequency), 6) AS top_frequency, round(max(frequency) - min(frequency), 6) AS contrast, CASE WHEN count(*) = 1 THEN 'private' ELSE 'shared' END AS status FROM b GROUP BY item""")
def recurrent_items(spark, sf):
    return rounded(sm.recurrent(_frequencies(spark, sf), "item", "grp"), "top_frequency", "contrast")


@query(f"""WITH {_FREQUENCIES}, a AS (SELECT item, count(*) AS n FROM f GROUP BY item) SELECT grp, count(*) AS n_items, count(*) FILTER (n = 1) AS n_exclusive FROM f JOIN a USING (item) GROUP BY grp""")
def group_exclusivity(spark, sf):
    return sm.exclusivity(_frequencies(spark, sf), "item", "grp")


@query("""WITH c AS (SELECT c_nationkey, c_acctbal FROM customer), p AS (SELECT a.c_nationkey, sum(abs(a.c_acctbal - b.c_acctbal)) AS s FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey GROUP BY a.c_nationkey), n AS (SELECT c_nationkey, count(*) AS n FROM c GROUP BY c_nationkey)
SELECT c_nationkey, round(coalesce(s / nullif(n * (n - 1), 0), 0), 4) AS mean, n FROM p JOIN n USING (c_nationkey)""")
def mean_pair_difference(spark, sf):
    return rounded(sm.mean_over_ordered_pairs(read(spark, sf, "customer"), ["c_nationkey"], "c_acctbal"), "mean", digits=4)


@query("""SELECT kind, coalesce(n, 0) AS n FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NEVER')) k(kind) LEFT JOIN (SELECT o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 1) USING (kind)""")
def category_spine(spark, sf):
    counts = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return sm.with_spine(counts, "kind", ["1-URGENT", "2-HIGH", "9-NEVER"], ["n"])


@query("""SELECT 'l_returnflag' AS question, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'F') AS "F", count(*) FILTER (l_returnflag = 'N') AS "N" FROM lineitem UNION ALL SELECT 'l_linestatus', count(*) FILTER (l_linestatus = 'A'), count(*) FILTER (l_linestatus = 'F'), count(*) FILTER (l_linestatus = 'N') FROM lineitem""")
def status_matrix(spark, sf):
    return sm.status_matrix(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["A", "F", "N"])


@query("""WITH n AS (SELECT l_returnflag, count(*) FILTER (l_quantity > 40) AS a, count(*) FILTER (l_quantity <= 40) AS b, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS c FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, 'far' AS context, a AS n_in, round(a / n / 0.2, 6) AS fold, round(log2((a / 2.0 + 1e-6) / (b / 8.0 + 1e-6)), 6) AS log2_fold FROM n UNION ALL SELECT l_returnflag, 'cheap', c, round(c / n / 0.5, 6), round(log2((a / 2.0 + 1e-6) / (b / 8.0 + 1e-6)), 6) FROM n""")
def context_enrichment(spark, sf):
    rows = read(spark, sf, "lineitem")
    folds = rows.groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 40).alias("a"), F.count_if(F.col("l_quantity") <= 40).alias("b"))
    folds = folds.select("l_returnflag", F.round(sm.density_fold(F.col("a"), F.lit(2e6), F.col("b"), F.lit(8e6)), 6).alias("log2_fold"))
    out = sm.context_enrichment(rows, "l_returnflag", {"far": (F.col("l_quantity") > 40, 0.2), "cheap": (F.col("l_discount") > 0.05, 0.5)})
    return out.join(F.broadcast(folds), "l_returnflag").select("l_returnflag", "context", "n_in", F.round("fold", 6).alias("fold"), "log2_fold")


@query("""SELECT l_returnflag, CASE WHEN l_quantity <= 1 THEN '00' WHEN l_quantity <= 5 THEN '01' WHEN l_quantity <= 20 THEN '02' ELSE '03' END AS bin, count(*) AS n FROM lineitem GROUP BY ALL""")
def carrier_histogram(spark, sf):
    return sm.histogram(read(spark, sf, "lineitem"), F.col("l_quantity"), [1, 5, 20], "l_returnflag")


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS c FROM customer GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY c_nationkey) AS p FROM c) SELECT c_nationkey, count(*) AS n_items, round(-sum(p * log2(p)), 6) AS bits, round(max(p), 6) AS largest, CASE WHEN max(p) >= 0.8 THEN 'bottleneck' WHEN max(p) >= 0.5 THEN 'skewed' ELSE 'diverse' END AS flag FROM p GROUP BY c_nationkey""")
def founder_diversity(spark, sf):
    return rounded(sm.diversity(read(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment"), "bits", "largest")


@query("""SELECT l_returnflag, 'l_discount' AS sample, count(*) FILTER (l_discount > 0) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_tax', count(*) FILTER (l_tax > 0) FROM lineitem GROUP BY 1""")
def melted_counts(spark, sf):
    return sm.melted_counts(read(spark, sf, "lineitem"), "l_returnflag", ["l_discount", "l_tax"])


@query("""WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events), g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS gap FROM e)
SELECT user_id, count(*) AS n, median(gap) AS median_gap, round(quantile_cont(gap, 0.9), 4) AS p90_gap, max(gap) AS largest_gap, round(count(*) * 1000.0 / nullif(max(pos) - min(pos), 0), 8) AS per_kb FROM g GROUP BY user_id""")
def gap_summary(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"))
    return rounded(rounded(sm.gap_summary(e, ["user_id"], "pos"), "p90_gap", digits=4), "per_kb", digits=8)


@query("""WITH r AS (SELECT l_suppkey, CASE WHEN l_linenumber < 6 THEN l_orderkey // 1000 END AS block, l_orderkey AS pos, l_returnflag = 'A' AS a, l_returnflag = 'R' AS b FROM lineitem), p AS (SELECT l_suppkey, block, count(*) AS k, max(pos) - min(pos) AS span, count(*) FILTER (a) AS tier1, count(*) FILTER (b) AS tier2 FROM r GROUP BY ALL)
SELECT l_suppkey, CAST(sum(k) AS BIGINT) AS n, CAST(sum(tier1) AS BIGINT) AS tier1, CAST(sum(tier2) AS BIGINT) AS tier2, count(block) AS n_blocks, max(k) FILTER (block IS NOT NULL) AS largest, round(avg(span) FILTER (block IS NOT NULL), 4) AS mean_span FROM p GROUP BY l_suppkey""")
def phase_support(spark, sf):
    r = read(spark, sf, "lineitem").withColumn("block", F.when(F.col("l_linenumber") < 6, F.floor(F.col("l_orderkey") / 1000)))
    return rounded(sm.block_support(r, "l_suppkey", "block", "l_orderkey", {"tier1": F.col("l_returnflag") == "A", "tier2": F.col("l_returnflag") == "R"}), "mean_span", digits=4)


@query("""WITH g AS (SELECT p_brand || p_type AS grp, count(*) AS n, count(*) FILTER (p_size < 30) AS n_core, CASE WHEN avg(p_retailprice) <> 0 THEN stddev_samp(p_retailprice) / avg(p_retailprice) END AS cv, avg(CAST(p_size > 10 AS INT)) AS coherent FROM part GROUP BY 1)
SELECT grp, n, n_core, round(cv, 6) AS cv, round(coherent, 6) AS coherent, CASE WHEN n < 5 THEN 'too_few' WHEN n_core < 3 THEN 'small_core' WHEN cv > 0.1 THEN 'dispersed' WHEN coherent < 0.6 THEN 'incoherent' ELSE 'eligible' END AS reason FROM g""")
def anchor_eligibility(spark, sf):
    p = read(spark, sf, "part").withColumn("grp", F.concat("p_brand", "p_type"))
    return rounded(sm.anchor_eligibility(p, "grp", "p_retailprice", F.col("p_size") > 10, F.col("p_size") < 30, most_cv=0.1), "cv", "coherent")
