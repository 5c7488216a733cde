"""Interval and sequence operators on the driver's tables, with their SQL.

Order spans stand for intervals: key = customer, start = order day, end = day
after the last shipment (at least one day).  Events stand for points: key =
user, pos = second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import windows as wn
from ..sources.tables import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

SPANS = """spans AS (
  SELECT o_custkey AS key, o_orderkey AS id, s AS start, greatest(s + 1, e + 1) AS "end" FROM (
    SELECT o_custkey, o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s,
           CAST(max(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS BIGINT) AS e
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate))"""
WIDTH = 64


def spans(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", day("o_orderdate").alias("start"))
    last = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(day("l_shipdate")).alias("e"))
    return o.join(last, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), "start", F.greatest(F.col("start") + 1, F.col("e") + 1).alias("end"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"), "event_type", "value")


EVENTS = "ev AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_type, value FROM events)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {SPANS} SELECT a.key, a.id AS l_id, b.id AS r_id, least(a."end", b."end") - greatest(a.start, b.start) AS overlap
FROM spans a JOIN spans b ON a.key = b.key AND a.id < b.id AND a.start < b."end" AND b.start < a."end" """)
def interval_overlap_join(spark, sf):
    s = spans(spark, sf)
    return iv.overlap_join(s, s, ["key"], WIDTH).where("l_id < r_id").select("key", "l_id", "r_id", "overlap")


_HALF = """(SELECT DISTINCT a.key, a.id FROM spans a JOIN spans b ON a.key = b.key AND a.id <> b.id AND a.start < b."end" AND b.start < a."end"
 WHERE b.id % 3 = 0 AND a.id % 3 <> 0 AND 2 * (least(a."end", b."end") - greatest(a.start, b.start)) >= a."end" - a.start)"""


@query(f"""WITH {SPANS} SELECT key, id, start, "end" FROM spans WHERE id % 3 <> 0 AND (key, id) IN {_HALF}""")
def interval_semi_join_half_covered(spark, sf):
    s = spans(spark, sf)
    return iv.covered_by_one(s.where("id % 3 <> 0"), s.where("id % 3 = 0"), ["key"], "id", 0.5, WIDTH, True)


@query(f"""WITH {SPANS} SELECT key, id, start, "end" FROM spans WHERE id % 3 <> 0 AND (key, id) NOT IN {_HALF}""")
def interval_anti_join_half_covered(spark, sf):
    s = spans(spark, sf)
    return iv.covered_by_one(s.where("id % 3 <> 0"), s.where("id % 3 = 0"), ["key"], "id", 0.5, WIDTH, False)


def _islands(rule: str, slack: int) -> str:
    reach = {"running_max": 'max("end") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', "last_member": 'lag("end") OVER w', "start_gap": "lag(start) OVER w"}[rule]
    return f"""WITH {SPANS}, m AS (SELECT *, {reach} AS reach FROM spans WINDOW w AS (PARTITION BY key ORDER BY start, "end", id))
SELECT key, id, CAST(sum(CASE WHEN reach IS NULL OR start > reach + {slack} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start, "end", id) AS BIGINT) AS island FROM m"""


def _island_query(name: str, rule: str, slack: int):
    def f(spark, sf):
        return iv.islands(spans(spark, sf), ["key"], slack, rule).select("key", "id", F.col("island").cast("long").alias("island"))

    f.__name__ = name
    query(_islands(rule, slack))(f)


_island_query("islands_running_max", "running_max", 0)
_island_query("islands_running_max_slack", "running_max", 20)
_island_query("islands_last_member", "last_member", 10)
_island_query("islands_start_gap", "start_gap", 50)

_MERGED = """m AS (SELECT *, max("end") OVER (PARTITION BY key ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start, "end", id) AS island FROM m),
merged AS (SELECT key, island, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY key, island)"""


@query(f"""WITH {SPANS}, {_MERGED} SELECT key, start, "end", n FROM merged""")
def interval_merge(spark, sf):
    return iv.merge(spans(spark, sf), ["key"]).select("key", "start", "end", "n")


@query(f"""WITH {SPANS}, {_MERGED}, e AS (SELECT key, start, "end" FROM merged UNION ALL SELECT DISTINCT key, 20000, 20000 FROM spans),
g AS (SELECT key, start, coalesce(lag("end") OVER (PARTITION BY key ORDER BY start), 0) AS f FROM e)
SELECT key, f AS start, start AS "end" FROM g WHERE f < start""")
def interval_complement(spark, sf):
    s = spans(spark, sf)
    return iv.complement(iv.merge(s, ["key"]), ["key"], s.select("key").distinct().withColumn("length", F.lit(20000).cast("long")))


@query(f"""WITH {SPANS}, b AS (SELECT key, id, unnest(range(start, "end")) AS d FROM spans WHERE id % 3 <> 0),
x AS (SELECT DISTINCT key, unnest(range(start, "end")) AS d FROM spans WHERE id % 3 = 0)
SELECT key, id, count(*) AS left_over FROM b ANTI JOIN x USING (key, d) GROUP BY key, id""")
def interval_subtract(spark, sf):
    s = spans(spark, sf)
    return iv.subtract(s.where("id % 3 <> 0"), s.where("id % 3 = 0"), ["key"], "id", WIDTH).groupBy("key", "id").agg(F.sum(F.col("end") - F.col("start")).alias("left_over"))


@query(f"""WITH {SPANS}, b AS (SELECT key, id, unnest(range(start, "end")) AS d FROM spans WHERE id % 3 <> 0),
x AS (SELECT DISTINCT key, unnest(range(start, "end")) AS d FROM spans WHERE id % 3 = 0)
SELECT key, id, count(x.d) AS covered FROM b LEFT JOIN x USING (key, d) GROUP BY key, id""")
def interval_coverage_union(spark, sf):
    s = spans(spark, sf)
    return iv.coverage(s.where("id % 3 <> 0"), s.where("id % 3 = 0"), ["key"], "id", WIDTH).select("key", "id", "covered")


@query(f"""WITH {SPANS} SELECT a.key, a.id, CAST(coalesce(sum(CASE WHEN b.id IS NOT NULL THEN least(a."end", b."end") - greatest(a.start, b.start) END), 0) AS BIGINT) AS covered
FROM spans a LEFT JOIN spans b ON a.key = b.key AND b.id % 3 = 0 AND a.start < b."end" AND b.start < a."end" WHERE a.id % 3 <> 0 GROUP BY a.key, a.id""")
def interval_coverage_sum(spark, sf):
    s = spans(spark, sf)
    return iv.coverage(s.where("id % 3 <> 0"), s.where("id % 3 = 0"), ["key"], "id", WIDTH, "sum").select("key", "id", "covered")


_POINTS = "p AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS point, o_custkey AS key, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def points(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    p = read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point"), "l_orderkey", F.unix_date(F.to_date("l_shipdate")).cast("long").alias("pos"))
    return p.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("point", "key", "pos").distinct()


@query(f"""WITH {SPANS}, {_POINTS}, r AS (SELECT point, p.key, pos, s.id, s."end", row_number() OVER (PARTITION BY point, pos ORDER BY s.start DESC, s."end" DESC, s.id DESC) AS k
 FROM p LEFT JOIN spans s ON s.key = p.key AND s.start <= pos) SELECT point, key, pos, CASE WHEN "end" > pos THEN id END AS range_id FROM r WHERE k = 1""")
def point_in_last_started_interval(spark, sf):
    return iv.last_started(points(spark, sf), spans(spark, sf), ["key"], "pos").select("point", "key", "pos", "range_id")


@query(f"""WITH {_POINTS}, o AS (SELECT DISTINCT o_custkey AS key, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS d FROM orders),
r AS (SELECT point, p.key, d, abs(pos - d) AS x, row_number() OVER (PARTITION BY point, pos ORDER BY abs(pos - d), d) AS k FROM p JOIN o ON o.key = p.key)
SELECT point, key, CASE WHEN x <= 30 THEN d END AS nearest, CASE WHEN x <= 30 THEN x END AS distance FROM r WHERE k = 1""")
def nearest_within_tolerance(spark, sf):
    marks = read(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.unix_date(F.to_date("o_orderdate")).cast("long").alias("d"))
    return iv.nearest(points(spark, sf), marks, ["key"], "pos", "d", 30).select("point", "key", "nearest", "distance")


@query(f"""WITH {SPANS}, r AS (SELECT a.key, a.id, b.id AS parent, b."end" - b.start AS size, row_number() OVER (PARTITION BY a.key, a.id ORDER BY b."end" - b.start, b.id) AS k
 FROM spans a JOIN spans b ON a.key = b.key AND a.id <> b.id AND b.start <= a.start AND b."end" >= a."end") SELECT key, id, parent, size FROM r WHERE k = 1""")
def smallest_enclosing_interval(spark, sf):
    s = spans(spark, sf)
    return iv.smallest_enclosing(s, s, ["key"], WIDTH)


@query(f"""WITH {SPANS}, h AS (SELECT a.key, a.id, b.id AS match, least(a."end", b."end") - greatest(a.start, b.start) AS overlap, a."end" - a.start AS la, b."end" - b.start AS lb
 FROM spans a JOIN spans b ON a.key = b.key AND a.id % 2 = 0 AND b.id % 2 = 1 AND a.start < b."end" AND b.start < a."end"),
r AS (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY overlap DESC, match) AS k FROM h WHERE 2 * overlap >= la AND 2 * overlap >= lb)
SELECT key, id, match, overlap FROM r WHERE k = 1""")
def reciprocal_overlap_match(spark, sf):
    s = spans(spark, sf)
    return iv.reciprocal_matches(s.where("id % 2 = 0"), s.where("id % 2 = 1"), ["key"], 0.5, WIDTH)


@query(f"""WITH {SPANS}, p AS (SELECT a.key, a.id AS a, b.id AS b, CASE WHEN a.start = b.start AND a."end" = b."end" THEN 'equal' WHEN a.start >= b.start AND a."end" <= b."end" THEN 'nested_1_in_2'
 WHEN b.start >= a.start AND b."end" <= a."end" THEN 'nested_2_in_1' ELSE 'partial_overlap' END AS relation
 FROM spans a JOIN spans b ON a.key = b.key AND a.id < b.id AND a.start < b."end" AND b.start < a."end") SELECT relation, count(*) AS n FROM p GROUP BY relation""")
def interval_relation_classes(spark, sf):
    s = spans(spark, sf)
    hit = iv.overlap_join(s, s, ["key"], WIDTH).where("l_id < r_id")
    return hit.groupBy(iv.relation("l_start", "l_end", "r_start", "r_end").alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY pos, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
w AS (SELECT user_id, k AS window_id, value FROM r, range(0, 100000) t(k) WHERE n >= 5 AND k * 2 <= r AND r < k * 2 + 5 AND k <= (n - 5) // 2)
SELECT user_id, window_id, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY user_id, window_id""")
def sliding_row_windows(spark, sf):
    w = iv.sliding_windows(events(spark, sf), ["user_id"], ["pos", "event_id"], 5, 2)
    return w.groupBy("user_id", "window_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"""WITH {EVENTS} SELECT event_id, pos - lag(pos) OVER w AS to_previous, lead(pos) OVER w - pos AS to_next FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos, event_id)""")
def neighbour_gaps(spark, sf):
    return wn.neighbour_gaps(events(spark, sf), ["user_id"], "pos", "event_id").select("event_id", "to_previous", "to_next")


@query(f"""WITH {EVENTS} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY pos RANGE BETWEEN 3600 PRECEDING AND 3600 FOLLOWING) - 1 AS within_3600,
 count(*) OVER (PARTITION BY user_id ORDER BY pos RANGE BETWEEN 86400 PRECEDING AND 86400 FOLLOWING) - 1 AS within_86400 FROM ev""")
def range_neighbour_counts(spark, sf):
    return wn.neighbour_counts(events(spark, sf), ["user_id"], "pos", [3600, 86400]).select("event_id", "within_3600", "within_86400")


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, event_type, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY pos, event_id) THEN 1 ELSE 0 END AS x FROM ev WHERE event_type IS NOT NULL),
c AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM s GROUP BY user_id, event_type),
a AS (SELECT user_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS switches FROM s GROUP BY user_id)
SELECT a.user_id, n, switches, event_type AS dominant, round(CASE WHEN n > 1 THEN 1 - switches / (n - 1) ELSE 1.0 END, 6) AS stability FROM a JOIN c ON c.user_id = a.user_id AND k = 1""")
def state_switches(spark, sf):
    return wn.state_switches(events(spark, sf), ["user_id"], ["pos", "event_id"], "event_type").withColumn("stability", F.round("stability", 6))


@query(f"""WITH {EVENTS}, n AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS x FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos, event_id)),
r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY pos, event_id) AS run FROM n)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS length FROM r GROUP BY user_id, run""")
def run_length_encoding(spark, sf):
    return wn.runs(events(spark, sf), ["user_id"], ["pos", "event_id"], "event_type").withColumn("run", F.col("run").cast("long"))


@query("""WITH c AS (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS m, avg(p_retailprice) AS a, stddev_samp(p_retailprice) AS s FROM part GROUP BY p_brand),
d AS (SELECT p_brand, quantile_cont(abs(p_retailprice - m), 0.5) * 1.4826 AS mad FROM part JOIN c USING (p_brand) GROUP BY p_brand)
SELECT p_partkey, round(CASE WHEN mad >= 1e-10 THEN (p_retailprice - m) / mad WHEN coalesce(s, 0) > 0 THEN (p_retailprice - a) / s ELSE 0 END, 6) AS z FROM part JOIN c USING (p_brand) JOIN d USING (p_brand)""")
def robust_z(spark, sf):
    return wn.robust_z(read(spark, sf, "part"), ["p_brand"], "p_retailprice").select("p_partkey", F.round("z", 6).alias("z"))


@query("""WITH t AS (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / (count(*) + 1.0) AS p FROM lineitem GROUP BY l_partkey),
r AS (SELECT l_partkey, p, least(1.0, p * count(*) OVER () / row_number() OVER (ORDER BY p, l_partkey)) AS raw, row_number() OVER (ORDER BY p, l_partkey) AS k FROM t)
SELECT l_partkey, round(min(raw) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS q FROM r""")
def benjamini_hochberg(spark, sf):
    t = read(spark, sf, "lineitem").groupBy("l_partkey").agg((F.count_if(F.col("l_returnflag") == "R") / (F.count(F.lit(1)) + 1.0)).alias("p"))
    return wn.benjamini_hochberg(t, "p").select("l_partkey", F.round("q", 9).alias("q"))


@query(f"""WITH {EVENTS} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean,
 round(median(value) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS median FROM ev""")
def rolling_mean_and_median(spark, sf):
    order = (["user_id"], ["pos", "event_id"], 5)
    return events(spark, sf).select("event_id", F.round(wn.rolling("value", *order), 6).alias("mean"), F.round(wn.rolling_median("value", *order), 6).alias("median"))


@query("""SELECT c_custkey, round((SELECT count(*) FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s_acctbal <= c_acctbal) / nullif((SELECT count(*) FROM supplier s WHERE s.s_nationkey = c.c_nationkey), 0), 9) AS fraction FROM customer c""")
def percentile_rank_against_reference(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("x"))
    s = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_acctbal").alias("x"))
    return wn.percentile_rank(c, s, "x", ["key"]).select("c_custkey", F.round("fraction", 9).alias("fraction"))


@query("""SELECT l_partkey, l_orderkey, l_linenumber, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 3""")
def top_n_per_group(spark, sf):
    t = wn.top_n(read(spark, sf, "lineitem"), ["l_partkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 3)
    return t.select("l_partkey", "l_orderkey", "l_linenumber", "rank")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def keep_best_per_key(spark, sf):
    return wn.keep_best(read(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")
