"""Matching of ranges and points on order spans and events, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..sources.tables import read
from .interval_queries import EVENTS, SPANS, WIDTH, events, spans

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
A, B = "(SELECT * FROM spans WHERE id % 2 = 0)", "(SELECT * FROM spans WHERE id % 2 = 1)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def halves(spark, sf):
    """Even orders on one side, odd ones on the other; both are used whole."""
    s = spans(spark, sf)
    return s.where("id % 2 = 0"), s.where("id % 2 = 1")


@query(f"""WITH {SPANS} SELECT a.key, a.id AS l_id, b.id AS r_id, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM {A} a JOIN {B} b ON a.key = b.key AND a.start < b."end" AND b.start < a."end" """)
def interval_clip(spark, sf):
    return iv.clipped(*halves(spark, sf), ["key"], WIDTH).select("key", "l_id", "r_id", "start", "end")


@query(f"""WITH {SPANS} SELECT a.key, a.id AS l_id, b.id AS r_id, least(a."end", b."end") - greatest(a.start, b.start) + 1 AS overlap FROM {A} a JOIN {B} b ON a.key = b.key AND a.start <= b."end" AND b.start <= a."end" """)
def interval_closed_overlap(spark, sf):
    return iv.closed_overlap_join(*halves(spark, sf), ["key"], WIDTH).select("key", "l_id", "r_id", "overlap")


@query(f"""WITH {SPANS} SELECT a.key, a.id, count(b.id) AS n_overlaps, count(b.id) > 0 AS any_overlap FROM {A} a LEFT JOIN {B} b ON a.key = b.key AND a.start < b."end" AND b.start < a."end" GROUP BY a.key, a.id""")
def interval_overlap_counts(spark, sf):
    return iv.overlap_counts(*halves(spark, sf), ["key"], "id", WIDTH).select("key", "id", "n_overlaps", "any_overlap")


@query(f"""WITH {SPANS} SELECT a.key, a.id, b.id % 5 AS kind, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start)) AS BIGINT) AS covered, round(sum(least(a."end", b."end") - greatest(a.start, b.start)) / any_value(a."end" - a.start), 12) AS share
FROM {A} a JOIN {B} b ON a.key = b.key AND a.start < b."end" AND b.start < a."end" GROUP BY a.key, a.id, b.id % 5""")
def interval_class_coverage(spark, sf):
    a, b = halves(spark, sf)
    return iv.class_coverage(a, b.withColumn("kind", F.col("id") % 5), ["key"], "id", "kind", WIDTH).withColumn("share", F.round("share", 12))


_POINTS = "p AS (SELECT o_custkey AS key, o_orderkey AS id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 40 AS at FROM orders)"


def points(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), (F.unix_date(F.to_date("o_orderdate")).cast("long") + 40).alias("at"))


@query(f"""WITH {SPANS}, {_POINTS} SELECT p.id, EXISTS (SELECT 1 FROM spans s WHERE s.key = p.key AND p.at BETWEEN s.start AND s."end") AS in_any, EXISTS (SELECT 1 FROM spans s WHERE s.key = p.key AND s."end" - s.start >= 60 AND p.at BETWEEN s.start AND s."end") AS in_long FROM p""")
def points_in_ranges(spark, sf):
    s, p = spans(spark, sf), points(spark, sf)
    short = iv.points_in_any(p, s, ["key"], "at", "id", WIDTH).select("id", F.col("inside").alias("in_any"))
    return short.join(iv.points_in_any(p, s, ["key"], "at", "id", WIDTH, 60).select("id", F.col("inside").alias("in_long")), "id")


@query(f"""WITH {SPANS}, h AS (SELECT a.key, a.id, b.id AS r, round(greatest(0, least(a."end", b."end") - greatest(a.start, b.start)) / (a."end" - a.start) * 100 - (abs(b.start - a.start) + abs(b."end" - a."end")) / 1000 * 0.1 + (1 - abs(1 - (b."end" - b.start) / (a."end" - a.start))) * 20, 6) AS score
FROM {A} a JOIN {B} b ON a.key = b.key AND b."end" > a.start - 30 AND b.start < a."end" + 31), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, r) AS k, count(*) OVER (PARTITION BY id) AS n_near FROM h) SELECT key, id, r AS match, score, n_near FROM k WHERE k = 1""")
def best_scored_match(spark, sf):
    return iv.best_scored(*halves(spark, sf), ["key"], WIDTH, 30)


@query(f"""WITH {SPANS}, h AS (SELECT a.id, b.id AS r, row_number() OVER (PARTITION BY a.id ORDER BY b.start, b."end", b.id) AS k FROM {A} a JOIN {B} b ON a.key = b.key AND abs(a.start - b.start) <= 60 AND abs(a."end" - b."end") <= 60)
SELECT a.key, a.id, h.r AS match FROM {A} a LEFT JOIN h ON h.id = a.id AND k = 1""")
def both_ends_match(spark, sf):
    return iv.both_ends_near(*halves(spark, sf), ["key"], 60).select("key", "id", "match")


@query(f"""WITH {SPANS}, c AS (SELECT key, id, start, "end" FROM spans), p AS (SELECT key, id AS pair, start AS s1, start + 5 AS e1, "end" AS s2, "end" + 5 AS e2 FROM spans)
SELECT DISTINCT c.key, c.id, pair FROM c JOIN p ON c.key = p.key WHERE (s1 <= c.start + 20 AND e1 >= c.start - 20 AND s2 <= c."end" + 20 AND e2 >= c."end" - 20) OR (s2 <= c.start + 20 AND e2 >= c.start - 20 AND s1 <= c."end" + 20 AND e1 >= c."end" - 20)""")
def straddling_pairs(spark, sf):
    s = spans(spark, sf)
    pairs = s.select("key", "id", F.col("start").alias("start1"), (F.col("start") + 5).alias("end1"), F.col("end").alias("start2"), (F.col("end") + 5).alias("end2"))
    return iv.straddling(s, pairs, ["key"], WIDTH, 20)


@query(f"""WITH {SPANS}, {_POINTS} SELECT s.key, s.id, count(p.id) FILTER (abs(p.at - s.start) <= 30 AND p.id % 2 = 0) AS "start_even", count(p.id) FILTER (abs(p.at - s.start) <= 30 AND p.id % 2 = 1) AS "start_odd", count(p.id) FILTER (abs(p.at - s."end") <= 30 AND p.id % 2 = 0) AS "end_even", count(p.id) FILTER (abs(p.at - s."end") <= 30 AND p.id % 2 = 1) AS "end_odd"
FROM spans s LEFT JOIN p ON p.key = s.key GROUP BY s.key, s.id""")
def marks_near_boundaries(spark, sf):
    marks = points(spark, sf).withColumn("kind", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    return iv.near_boundary_counts(marks, spans(spark, sf), ["key"], "at", "kind", ["even", "odd"], WIDTH, 30).drop("start", "end")


@query(f"""WITH {SPANS}, c AS (SELECT *, greatest(CAST(ceil(("end" - start) * 0.2) AS BIGINT), 10) AS f FROM {A}), h AS (SELECT c.key, c.id, count(*) FILTER (b.start <= c."end" AND b."end" >= c.start) AS n_inside, count(*) FILTER (b.start <= c.start - 1 AND b."end" >= c.start - f) AS n_left, count(*) FILTER (b.start <= c."end" + f AND b."end" >= c."end" + 1) AS n_right,
 list_sort(list_distinct(list(CASE WHEN b.start <= c."end" AND b."end" >= c.start THEN CAST(b.id AS VARCHAR) END))) AS l FROM c JOIN {B} b ON b.key = c.key GROUP BY c.key, c.id)
SELECT c.key, c.id, coalesce(n_inside, 0) AS n_inside, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right, CASE WHEN n_inside > 0 THEN array_to_string(list_filter(l, lambda x: x IS NOT NULL)[1:5], ',') END AS names FROM c LEFT JOIN h ON h.id = c.id""")
def genes_and_flanks(spark, sf):
    a, b = halves(spark, sf)
    return iv.overlap_and_flanks(a, b.withColumn("name", F.col("id").cast("string")), ["key"], WIDTH, least=10).drop("start", "end")


@query(f"""WITH {EVENTS}, m AS (SELECT DISTINCT user_id, pos AS mark FROM ev WHERE event_id % 5 = 0), r AS (SELECT e.user_id, event_id, pos, max(mark) AS mark FROM ev e LEFT JOIN m ON m.user_id = e.user_id AND mark <= pos GROUP BY ALL) SELECT event_id, mark, mark = pos AS exact FROM r""")
def exact_or_lower_mark(spark, sf):
    e = events(spark, sf)
    marks = e.where("event_id % 5 = 0").select("user_id", F.col("pos").alias("mark")).distinct()
    return iv.exact_or_lower(e.select("user_id", "event_id", "pos"), marks, ["user_id"], "pos", "mark").select("event_id", "mark", "exact")


@query("""WITH RECURSIVE e AS (SELECT o_orderkey // 3 AS parent, o_orderkey AS child FROM orders WHERE o_orderkey <> o_orderkey // 3), d AS (SELECT parent AS ancestor, child AS node, 1 AS depth FROM e UNION ALL SELECT ancestor, child, depth + 1 FROM d JOIN e ON parent = node) SELECT DISTINCT ancestor, node, depth FROM d""")
def tree_descendants(spark, sf):
    o = F.col("o_orderkey")
    edges = read(spark, sf, "orders").select(F.floor(o / 3).alias("parent"), o.alias("child")).where("parent <> child")
    return iv.descendants(edges)
