"""Sequence scalars, window operators and sampling on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import intervals as iv
from ..operators import sampling as sp
from ..operators import windows as wn
from ..sources.tables import read
from .interval_queries import EVENTS, events
from .rule_queries import ROW, turn

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_INDEL = ROW | {"kind": turn("l_partkey", "INS", "DEL", "SNP"), "len": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_partkey % 9 AS INT) END", "ref": turn("l_suppkey", "A", "ACGT", "GATTACA"), "alt": turn("l_orderkey", "AC", "A", "GATT"), "lf": turn("l_linenumber", "ACGTACGTAAC", None, "TTTTGACCA", "GG"), "rf": turn("l_orderkey", "acgtaccc", "ggTTTTGACCA", "AACGTACGTAAC", None, "GGGGG")}
_LIST = ", ".join(f"{e} AS {n}" for n, e in _INDEL.items())


@query(f"""WITH i AS (SELECT {_LIST} FROM lineitem) SELECT l_orderkey, l_linenumber, l_orderkey || ':' || l_linenumber || ':' || kind || ':' || coalesce(len, 0) || ':' || ref || '>' || alt || ':' || coalesce(right(lf, 5), '') || '|' || coalesce(left(rf, 5), '') AS signature,
 CASE kind WHEN 'INS' THEN alt[greatest(least(len(ref), len(alt)), 1):] WHEN 'DEL' THEN ref[greatest(least(len(ref), len(alt)), 1):] ELSE '' END AS motif, upper(substr(rf, 3, 4)) AS flank,
 coalesce(list_max(list_filter(range(3, 11), lambda k: len(lf) >= k AND strpos(rf, right(lf, CAST(k AS INT))) BETWEEN 1 AND 8)), 0) AS duplication FROM i""")
def indel_events(spark, sf):
    c = F.col
    i = read(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _INDEL.items()])
    return i.select("l_orderkey", "l_linenumber", sq.event_signature(c("l_orderkey"), c("l_linenumber"), c("kind"), c("len"), c("ref"), c("alt"), c("lf"), c("rf")).alias("signature"), sq.indel_motif(c("kind"), c("ref"), c("alt")).alias("motif"), sq.flank(c("rf"), F.lit(2), F.lit(6)).alias("flank"), sq.target_site_duplication(c("lf"), c("rf"), 3, 10, 8).cast("long").alias("duplication"))


_NAMES = {"p_partkey": "p_partkey", "chrom": turn("p_partkey", "chr01", "LG12", "7", "ctg_3", "X"), "te": turn("p_size", "LTR/Gypsy", "LINE/L1", "Simple_repeat", "DNA/hAT", "unknown"), "nc": turn("p_partkey", "tRNA", "misc", "pre_miRNA", "lncRNA"), "grp": turn("p_size", "inv_c12_HOM1", "inv_c12_HET__sub3", "inv_c1_HOM2__family_f9", "inv_c7_HET__noise"), "bp": "p_size * 40000", "txt": turn("p_partkey", "", "NA", "x", None), "one": turn("p_partkey", "R", "H", "I", None), "two": turn("p_size", "R", "H", "I")}


@query(f"""WITH i AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _NAMES.items())} FROM part) SELECT p_partkey, CASE chrom WHEN 'chr01' THEN 'LG1' WHEN '7' THEN 'LG7' ELSE chrom END AS chrom, CASE te WHEN 'LTR/Gypsy' THEN 'LTR' WHEN 'LINE/L1' THEN 'LINE' WHEN 'Simple_repeat' THEN 'Simple' WHEN 'DNA/hAT' THEN 'DNA' ELSE 'Other' END AS te, CASE nc WHEN 'tRNA' THEN 'tRNA' WHEN 'pre_miRNA' THEN 'miRNA' WHEN 'lncRNA' THEN 'lncRNA' ELSE 'other_ncRNA' END AS nc,
 split_part(split_part(grp, '__', 1), '_', 3) AS karyotype, CASE WHEN grp LIKE '%\\_\\_sub%' ESCAPE '\\' THEN 'karyotype_subcluster' WHEN grp LIKE '%family%' THEN 'family' WHEN grp LIKE '%noise' THEN 'karyotype_subcluster_noise' ELSE 'karyotype' END AS dimension, CASE WHEN strpos(grp, '__') > 0 THEN split_part(grp, '__', 1) END AS parent,
 CASE WHEN bp < 1000000 THEN (bp // 1000) || 'kb' ELSE (bp // 1000000) || 'Mb' END AS label, CASE WHEN txt IS NULL OR txt IN ('', 'NA') THEN 'none' ELSE txt END AS txt,
 CASE list_sort([one, two])[1] || list_sort([one, two])[2] WHEN 'RR' THEN 'concord_R' WHEN 'II' THEN 'concord_I' WHEN 'IR' THEN 'complementary' WHEN 'HR' THEN 'het_segregating' WHEN 'HI' THEN 'het_segregating' WHEN 'HH' THEN 'het_x_het' END AS outcome, sha256(CAST(p_partkey AS VARCHAR)) AS digest FROM i""")
def names_and_outcomes(spark, sf):
    c = F.col
    i = read(spark, sf, "part").selectExpr(*[f"{e} AS {n}" for n, e in _NAMES.items()]).withColumn("g", sq.group_name(c("grp")))
    return i.select("p_partkey", sq.chromosome(c("chrom")).alias("chrom"), sq.repeat_bucket(c("te")).alias("te"), sq.non_coding_class(c("nc"), F.lit(None)).alias("nc"), "g.karyotype", "g.dimension", "g.parent", sq.bin_label(c("bp")).alias("label"), sq.or_else(c("txt"), "none").alias("txt"), sq.cross_outcome(c("one"), c("two")).alias("outcome"), sq.content_digest(c("p_partkey").cast("string").cast("binary")).alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / 25 - 2 * (l_discount * l_tax + l_tax * 0.5), 6) AS residual, greatest(l_discount, l_tax, 0.05) AS largest, greatest(l_discount, l_tax, 0.05) < 0.07 AS uncertain,
 CASE WHEN l_discount >= l_tax AND l_discount >= 0.05 THEN 'Q1' WHEN l_tax >= 0.05 THEN 'Q2' ELSE 'Q3' END AS label, l_linenumber || '.' || CAST(l_linenumber % 3 AS VARCHAR) AS compact FROM lineitem""")
def ancestry_scalars(spark, sf):
    c = F.col
    shares = F.array(c("l_discount"), c("l_tax"), F.lit(0.05))
    call = sq.certain_call(shares, 0.07)
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(sq.residual_dosage(c("l_quantity") / 25, F.array(c("l_discount"), c("l_tax")), F.array(c("l_tax"), F.lit(0.5))), 6).alias("residual"), call["largest"].alias("largest"), call["uncertain"].alias("uncertain"),
        sq.ancestry_label(shares).alias("label"), sq.compact_row(F.array(c("l_linenumber"), F.lit(None).cast("int"), c("l_linenumber") % 3)).alias("compact"),
    )


@query(f"""WITH {EVENTS}, l AS (SELECT user_id, pos, event_id, value - 50 AS v FROM ev), s AS (SELECT *, last_value(nullif(sign(v), 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS s FROM l), p AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY pos, event_id) AS p FROM s)
SELECT user_id, count(*) AS n, count(*) FILTER (s <> p) AS flips, count(*) FILTER (p < 0 AND s > 0) AS upward FROM p GROUP BY user_id""")
def sign_flips(spark, sf):
    return wn.sign_flips(events(spark, sf).withColumn("v", F.col("value") - 50), ["user_id"], ["pos", "event_id"], "v")


@query(f"""WITH {EVENTS} SELECT user_id, pos, event_id, row_number() OVER (ORDER BY user_id, pos, event_id) AS global_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place, CAST((row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1) * 5 // count(*) OVER (PARTITION BY user_id) AS BIGINT) AS block, dense_rank() OVER (ORDER BY event_type) AS kind FROM ev""")
def ranks_and_ids(spark, sf):
    e = wn.rank_blocks(wn.global_ids(events(spark, sf), "user_id", ["pos", "event_id"]), ["user_id"], [F.desc("value"), "event_id"], 5)
    return wn.group_ids(e, ["event_type"], "kind").select("user_id", "pos", "event_id", "global_id", F.col("place").cast("long").alias("place"), "block", F.col("kind").cast("long").alias("kind"))


@query(f"""WITH {EVENTS}, s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY pos, event_id) AS before FROM ev) SELECT user_id, pos, event_id, before, event_type AS after FROM s WHERE before <> event_type""")
def switch_events(spark, sf):
    return wn.switch_events(events(spark, sf), ["user_id"], ["pos", "event_id"], "event_type")


@query(f"""WITH {EVENTS}, f AS (SELECT *, value > 50 AS f FROM ev), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos, event_id) - row_number() OVER (PARTITION BY user_id, f ORDER BY pos, event_id) AS g FROM f), r AS (SELECT user_id, f, count(*) AS n FROM g GROUP BY user_id, f, g) SELECT user_id, coalesce(max(n) FILTER (f), 0) AS longest FROM r GROUP BY user_id""")
def longest_run(spark, sf):
    return wn.longest_run(events(spark, sf).withColumn("f", F.col("value") > 50), ["user_id"], ["pos", "event_id"], "f")


@query(f"""WITH {EVENTS}, o AS (SELECT *, sum(CASE WHEN value > 50 THEN value ELSE -value END) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM ev) SELECT event_id, CASE WHEN s < 0 THEN -1 ELSE 1 END AS consensus FROM o""")
def smoothed_sign(spark, sf):
    e = events(spark, sf).withColumn("sign", F.when(F.col("value") > 50, 1).otherwise(-1))
    return wn.smoothed_sign(e, ["user_id"], ["pos", "event_id"], "sign", "value", 3).select("event_id", "consensus")


@query(f"""WITH {EVENTS}, b AS (SELECT *, pos - (SELECT min(pos) FROM ev) AS q FROM ev), l AS (SELECT user_id, max(q) + 1 AS length FROM b GROUP BY user_id), w AS (SELECT user_id, length, unnest(range(0, CAST((length - 7200) // 3600 AS BIGINT) + 1)) AS k FROM l WHERE length >= 7200)
SELECT w.user_id, w.k AS "window", count(*) AS n FROM w JOIN b ON b.user_id = w.user_id AND q >= k * 3600 AND q < k * 3600 + 7200 GROUP BY ALL""")
def position_windows(spark, sf):
    e = events(spark, sf)
    e = e.crossJoin(F.broadcast(e.agg(F.min("pos").alias("m")))).withColumn("q", F.col("pos") - F.col("m"))  # one row
    lengths = e.groupBy("user_id").agg((F.max("q") + 1).alias("length"))
    return wn.position_windows(e, ["user_id"], "q", lengths, 7200, 3600).groupBy("user_id", "window").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT n_nationkey, count(*) AS length FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey) SELECT n_nationkey, length, CAST(coalesce(sum(length) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l""")
def genome_offsets(spark, sf):
    lengths = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("length"))
    return wn.offsets(lengths, "n_nationkey", "length")


@query("""WITH m AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS spot, l_partkey, l_extendedprice, l_shipdate, CASE WHEN l_discount < l_tax THEN 1 WHEN l_tax < l_discount THEN 2 END AS l FROM lineitem), k AS (SELECT *, min(spot) OVER (PARTITION BY l_suppkey) AS lo, greatest(max(spot) OVER (PARTITION BY l_suppkey) - min(spot) OVER (PARTITION BY l_suppkey), 1) AS span, CAST(l <> lag(l) OVER (PARTITION BY l_suppkey ORDER BY spot, l_partkey, l_extendedprice, l_shipdate) AS INT) AS s FROM m WHERE l IS NOT NULL),
b AS (SELECT l_suppkey, least((spot - lo) * 4 // span, 3) AS b, count(*) AS n, count(*) FILTER (l = 1) AS a, coalesce(sum(s), 0) AS s FROM k GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS nn, sum(a) OVER (PARTITION BY l_suppkey) AS aa FROM b)
SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / (sum(n) - 1), 6) AS switch_rate, round(avg(CAST((2 * a >= n) = (2 * aa >= nn) AS INT)), 6) AS agreement FROM w GROUP BY l_suppkey""")
def block_coherence(spark, sf):
    li = read(spark, sf, "lineitem").withColumn("at", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    out = wn.block_coherence(li, ["l_suppkey"], "at", ["l_partkey", "l_extendedprice", "l_shipdate"], F.col("l_discount"), F.col("l_tax"))
    return out.select("l_suppkey", "n", F.round("switch_rate", 6).alias("switch_rate"), F.round("agreement", 6).alias("agreement"))


@query(f"""WITH {EVENTS}, r AS (SELECT *, lag(pos) OVER (PARTITION BY user_id ORDER BY pos, event_id) AS p FROM ev WHERE value > 60), i AS (SELECT *, sum(CASE WHEN p IS NULL OR pos > p + 40000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos, event_id) AS island FROM r) SELECT user_id, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM i GROUP BY user_id, island HAVING count(*) >= 3""")
def outlier_runs(spark, sf):
    e = events(spark, sf).where("value > 60").select("user_id", F.col("event_id").alias("id"), F.col("pos").alias("start"), F.col("pos").alias("end"))
    return iv.islands(e, ["user_id"], 40_000, "last_member").groupBy("user_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("island")


_HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_EVEN = """x AS (SELECT user_id, min(pos) AS lo, max(pos) AS hi FROM ev GROUP BY user_id), b AS (SELECT e.user_id, event_id, pos, lo, greatest(hi - lo, 1) AS span FROM ev e JOIN x ON x.user_id = e.user_id),
c AS (SELECT *, least((pos - lo) * {n} // span, {m}) AS bin FROM b), even AS (SELECT user_id, event_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id, bin ORDER BY abs(2 * {n} * (pos - lo) - (2 * bin + 1) * span), pos, event_id) AS k FROM c) WHERE k = 1)"""


@query(f"""WITH {EVENTS}, {_EVEN.format(n=7, m=6)}, v AS (SELECT user_id, event_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, pos, event_id) AS k FROM ev) WHERE k <= 3) SELECT user_id, event_id, pos FROM even UNION SELECT user_id, event_id, pos FROM v""")
def hybrid_sites(spark, sf):
    """Seven even sites and the three of the largest value a user: a sampling operator."""
    return sp.hybrid_sites(events(spark, sf), ["user_id"], "value", "pos", "event_id", 10).select("user_id", "event_id", "pos")


@query(f"""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_HASH.format("'42:' || c_custkey")}, c_custkey) AS k FROM customer) SELECT c_nationkey, c_custkey FROM r WHERE k <= 10""")
def background_draw(spark, sf):
    return sp.draw(read(spark, sf, "customer"), ["c_nationkey"], "c_custkey", 10, 42).select("c_nationkey", "c_custkey")


@query(f"""WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS row FROM supplier), d AS (SELECT i // 50 AS replicate, i % 50 AS draw FROM range(0, 1000) t(i)), h AS (SELECT *, {_HASH.format("'7:' || replicate || ':' || draw")} % (SELECT count(*) FROM n) AS row FROM d) SELECT replicate, draw, s_suppkey FROM h JOIN n USING (row)""")
def bootstrap_panels(spark, sf):
    return sp.bootstrap(read(spark, sf, "supplier"), "s_suppkey", ["s_acctbal"], 20, 50, 7)


@query(f"""WITH o AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row FROM part WHERE p_size >= 25), z AS (SELECT p_brand, count(*) AS n FROM o GROUP BY p_brand), k AS (SELECT p_brand, d, {_HASH.format("'3:' || p_brand || ':' || d || ':' || i")} % n AS row FROM z, range(0, 40) a(d), range(0, 15) b(i)),
m AS (SELECT k.p_brand, d, avg(p_retailprice) AS m FROM k JOIN o ON o.p_brand = k.p_brand AND o.row = k.row GROUP BY ALL), u AS (SELECT p_brand, avg(m) AS null_mean, stddev_samp(m) AS null_sd FROM m GROUP BY p_brand), s AS (SELECT p_brand, avg(p_retailprice) AS observed FROM part WHERE p_size < 25 GROUP BY p_brand)
SELECT p_brand, round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, CASE WHEN null_sd > 0 THEN round((observed - null_mean) / null_sd, 6) END AS z FROM s LEFT JOIN u USING (p_brand)""")
def resampled_z(spark, sf):
    out = sp.resampled_z(read(spark, sf, "part"), ["p_brand"], "p_partkey", "p_retailprice", F.col("p_size") < 25, 40, 15, 3)
    return out.select("p_brand", *[F.round(c, 6).alias(c) for c in ("observed", "null_mean", "null_sd", "z")])


@query(f"""WITH i AS (SELECT p_brand, p_partkey AS id, CAST(p_size AS DOUBLE) AS l, p_retailprice AS d FROM part), h AS (SELECT t.p_brand, t.id AS target, p.id AS match, row_number() OVER (PARTITION BY t.id ORDER BY {_HASH.format("'5:' || t.id || ':' || p.id")}, p.id) AS rank FROM i t JOIN i p ON t.p_brand = p.p_brand AND t.id <> p.id AND abs(p.l - t.l) <= 0.5 * t.l AND abs(p.d - t.d) <= 0.5 * t.d) SELECT p_brand, target, match, rank FROM h WHERE rank <= 2""")
def matched_draws(spark, sf):
    p = read(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("l"), F.col("p_retailprice").alias("d"))
    return sp.matched_draws(p, p, ["p_brand"], "l", "d", 2, 5).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH p AS (SELECT p_brand, p_partkey AS id, p_retailprice AS spot, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part), d AS (SELECT a.p_brand, a.id AS u, b.id AS v, abs(a.spot - b.spot) AS d, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.spot - b.spot), abs(a.r - b.r), b.id) AS k FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.id <> b.id) SELECT DISTINCT p_brand, least(u, v) AS u, greatest(u, v) AS v, round(d, 6) AS distance FROM d WHERE k <= 4""")
def nearest_edges(spark, sf):
    return sp.nearest_edges(read(spark, sf, "part"), ["p_brand"], "p_retailprice", "p_partkey", 4).withColumn("distance", F.round("distance", 6)).distinct()


@query("""WITH s AS (SELECT p_brand, p_partkey, p_size / 50 + CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 0 END AS score FROM part WHERE p_size / 50 >= 0.6), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM s) SELECT p_brand, p_partkey, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def seed_markers(spark, sf):
    out = sp.seed_markers(read(spark, sf, "part"), ["p_brand"], F.col("p_size") / 50, F.col("p_partkey") % 2 == 0, "p_partkey", 5)
    return out.select("p_brand", "p_partkey", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_custkey * 10 + o_orderkey % 10 AS item, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1 ORDER BY item LIMIT 25""")
def top_singletons(spark, sf):
    """A top-k report."""
    return sp.singletons(read(spark, sf, "orders").withColumn("item", F.col("o_custkey") * 10 + F.col("o_orderkey") % 10), "item", "o_orderpriority", ["item"], 25)
