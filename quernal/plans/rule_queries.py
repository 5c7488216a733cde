"""The rule tables on columns derived from the driver's tables, with their SQL.

Each query derives a rule family's inputs by plain expressions, which its SQL
shares, and applies the rules, which the SQL spells out on its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence_rules as ev
from ..operators import variant_rules as vr
from ..sources.tables import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
ROW = {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber"}


def case(value: str, *rules: tuple[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {value}{c} THEN '{label}'" for c, label in rules) + f" ELSE '{otherwise}' END"


def turn(key: str, *labels: str) -> str:
    """One of the labels by a number's remainder; a label of None is null."""
    named = ["NULL" if x is None else f"'{x}'" for x in labels]
    return f"CASE {key} % {len(labels)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(named[:-1])) + f" ELSE {named[-1]} END"


def query(table: str, columns: dict[str, str], sql: str):
    """Registers f(inputs) with SQL over a view `i` of the same inputs."""

    def register(f):
        def run(spark, sf):
            return f(read(spark, sf, table).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()]))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = f"WITH i AS (SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table})\n{sql}"
        return run

    return register


CALLS = ROW | {"gt": turn("(l_orderkey + l_linenumber)", "0/0", "0|1", "1/1", "./1", "1|2", ".", "1/0", None), "p": "l_returnflag = 'R'", "f": "l_linestatus = 'F'", "n_alt": "CAST(l_quantity AS INT) % 3"}


@query(
    "lineitem",
    CALLS,
    """SELECT l_orderkey, l_linenumber, CASE WHEN gt IS NULL OR gt IN ('.', './1') THEN 'miss' WHEN gt = '0/0' THEN 'AA' WHEN gt = '1/1' THEN 'BB' ELSE 'AB' END AS code,
 CASE gt WHEN '0/0' THEN 0 WHEN '0|1' THEN 1 WHEN '1/0' THEN 1 WHEN '1/1' THEN 2 END AS dosage, CASE gt WHEN '0/0' THEN 0 WHEN '0|1' THEN 1 WHEN '1/0' THEN 1 WHEN '1/1' THEN 1 END AS presence,
 CASE WHEN p AND f THEN 'PF' WHEN p THEN 'P' WHEN f THEN 'F' ELSE 'NONE' END AS source,
 CASE WHEN gt IN ('0|1', '1/0', '1/1') THEN 'strong' WHEN gt = '0/0' AND n_alt >= 1 THEN 'weak' WHEN gt = '0/0' THEN 'absent' ELSE 'missing' END AS evidence FROM i""",
)
def call_codes(i):
    c = F.col
    return i.select("l_orderkey", "l_linenumber", vr.genotype_code(c("gt")).alias("code"), vr.call_dosage(c("gt")).alias("dosage"), vr.call_presence(c("gt")).alias("presence"), vr.caller_source(c("p"), c("f")).alias("source"), ev.read_evidence(c("gt"), c("n_alt")).alias("evidence"))


RECORDS = ROW | {
    "var_type": turn("l_partkey", "SNP", "INS", "DEL", "OTHER"),
    "status": "CASE WHEN l_orderkey % 5 = 0 THEN 'PASS' ELSE 'FILTERED' END",
    "gt_class": turn("(l_orderkey + l_linenumber)", "HET", "HOM_VAR", "HOM_REF", "OTHER"),
    "qual": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END",
    "dp": "CAST(l_suppkey % 8 AS INT)",
    "af": "l_discount * 4",
    "ad_alt": "CAST(l_partkey % 4 AS INT)",
    "gq": "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_tax * 100 END",
    "n_local": "CAST(l_partkey % 5 AS INT)",
    "near20": "CAST(l_suppkey % 9 AS INT)",
    "indel_len": "CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(l_suppkey % 120 AS INT) END",
    "confirmed": "l_suppkey % 3 = 0",
    "weak": "l_suppkey % 3 = 1",
    "overlapping": "l_linenumber = 2",
}
_RESCUED = """r AS (SELECT *, CASE WHEN status = 'PASS' THEN 'pass' WHEN var_type IN ('INS', 'DEL') AND qual >= 8 AND dp >= 4 AND af >= 0.25 AND ad_alt >= 2 AND (gq IS NULL OR gq >= 5) THEN 'strong_indel'
 WHEN gt_class IN ('HET', 'HOM_VAR') AND var_type IN ('INS', 'DEL') AND qual >= 5 AND dp >= 3 AND af >= 0.15 AND ad_alt >= 1 THEN 'relaxed_indel'
 WHEN gt_class IN ('HET', 'HOM_VAR') AND var_type = 'SNP' AND qual >= 12 AND dp >= 3 AND af >= 0.15 AND ad_alt >= 1 THEN 'strong_snp_q12' ELSE 'none' END AS why FROM i),
f AS (SELECT *, CASE WHEN why = 'pass' THEN 'STRICT_PASS' WHEN why <> 'none' THEN 'RESCUED_STRONG_SINGLE_SAMPLE' WHEN var_type IN ('INS', 'DEL') AND confirmed THEN 'RESCUED_POPULATION_SIGNATURE'
 WHEN var_type IN ('INS', 'DEL') AND weak THEN 'WEAK_SIGNATURE_CANDIDATE' WHEN overlapping THEN 'COMPLEX_LOCAL_BLOCK_ONLY' ELSE 'FILTERED_DISCARD' END AS final FROM r)"""


def _finals(i):
    c = F.col
    i = i.withColumn("r", vr.rescue(*[c(x) for x in ("var_type", "status", "gt_class", "qual", "dp", "af", "ad_alt", "gq")]))
    return i.withColumn("f", vr.final_class(c("r.final_class"), c("r.layer"), c("r.reason"), c("var_type").isin("INS", "DEL"), c("confirmed"), c("weak"), F.lit(True), c("overlapping")))


@query(
    "lineitem",
    RECORDS,
    _RESCUED.replace("r AS", ", r AS", 1)
    + """ SELECT l_orderkey, l_linenumber, final AS final_class, CASE final WHEN 'STRICT_PASS' THEN 'strict_marker' WHEN 'RESCUED_STRONG_SINGLE_SAMPLE' THEN 'relaxed_marker' WHEN 'RESCUED_POPULATION_SIGNATURE' THEN 'rescued_population_marker'
 WHEN 'WEAK_SIGNATURE_CANDIDATE' THEN 'weak_signature_candidate' WHEN 'COMPLEX_LOCAL_BLOCK_ONLY' THEN 'complex_block_only' ELSE 'discard' END AS layer,
 CASE final WHEN 'RESCUED_POPULATION_SIGNATURE' THEN 'population_regenotype' WHEN 'WEAK_SIGNATURE_CANDIDATE' THEN 'weak_candidate' WHEN 'COMPLEX_LOCAL_BLOCK_ONLY' THEN 'complex_block' ELSE why END AS reason FROM f""",
)
def final_classification(i):
    return _finals(i).select("l_orderkey", "l_linenumber", "f.final_class", "f.layer", "f.reason")


@query(
    "lineitem",
    RECORDS,
    _RESCUED.replace("r AS", ", r AS", 1)
    + """, k AS (SELECT *, var_type IN ('INS', 'DEL') AS indel, coalesce(qual >= 30 AND dp >= 5 AND af >= 0.2 AND n_local <= 2, FALSE) AS clean, coalesce(qual >= 10 AND dp >= 4 AND af >= 0.25 AND n_local <= 3, FALSE) AS solid FROM f),
s AS (SELECT *, CASE WHEN final = 'STRICT_PASS' THEN CASE WHEN var_type = 'SNP' THEN CASE WHEN clean THEN 'A direct_snp_high_conf' ELSE 'D exploratory_only' END
 WHEN indel THEN CASE WHEN clean AND indel_len <= 30 THEN 'A direct_indel_high_conf' WHEN clean AND indel_len <= 100 THEN 'B direct_indel_medium' ELSE 'D exploratory_only' END ELSE 'B pass_messy_context' END
 WHEN final = 'RESCUED_STRONG_SINGLE_SAMPLE' THEN CASE WHEN var_type = 'SNP' THEN CASE WHEN qual >= 15 AND dp >= 4 AND n_local <= 3 THEN 'B rescued_snp_strong' ELSE 'C rescued_snp_conditional' END
 WHEN solid AND indel_len <= 30 THEN 'B rescued_indel_strong' WHEN solid THEN 'C rescued_indel_large' ELSE 'C rescued_indel_weak' END
 WHEN final = 'RESCUED_POPULATION_SIGNATURE' THEN 'C population_rescued' WHEN final = 'WEAK_SIGNATURE_CANDIDATE' THEN 'D weak_candidate' ELSE 'E not_recommended' END AS tag FROM k)
SELECT l_orderkey, l_linenumber, left(tag, 1) AS marker_class, substr(tag, 3) AS subclass,
 CASE substr(tag, 3) WHEN 'direct_snp_high_conf' THEN 'high' WHEN 'direct_indel_high_conf' THEN 'high' WHEN 'weak_candidate' THEN 'none' WHEN 'not_recommended' THEN 'none' WHEN 'direct_indel_medium' THEN 'medium' WHEN 'pass_messy_context' THEN 'medium' WHEN 'rescued_snp_strong' THEN 'medium' WHEN 'rescued_indel_strong' THEN 'medium' ELSE 'low' END AS priority,
 CASE WHEN var_type = 'SNP' THEN 'KASP_or_TaqMan' WHEN indel_len <= 5 THEN 'KASP_or_fragment_analysis' WHEN indel_len <= 30 THEN 'fragment_analysis' ELSE 'gel_or_capillary' END AS assay,
 CASE WHEN n_local <= 1 AND near20 <= 3 THEN 'yes' ELSE 'no' END AS easy, CASE WHEN n_local > 3 OR near20 > 6 THEN 'yes' ELSE 'no' END AS hard,
 coalesce(nullif(concat_ws('; ', CASE WHEN n_local > 2 THEN 'high_local_variant_density' END, CASE WHEN indel_len > 50 THEN 'large_indel' END, CASE WHEN overlapping THEN 'overlapping_events' END), ''), 'none') AS caution FROM s""",
)
def marker_classes(i):
    c = F.col
    i = _finals(i).withColumn("m", vr.marker_class(c("f.final_class"), c("var_type"), c("f.reason"), c("qual"), c("dp"), c("af"), c("n_local"), c("indel_len")))
    i = i.withColumn("q", vr.primer_feasibility(c("var_type"), c("indel_len"), c("n_local"), c("near20"), c("overlapping")))
    return i.select("l_orderkey", "l_linenumber", "m.marker_class", "m.subclass", "m.priority", "q.assay", "q.easy", "q.hard", "q.caution")


EFFECTS = ROW | {
    "var_type": turn("l_partkey", "SNP", "DEL", "INDEL", "BND", "INS", "DUP", "snp"),
    "consequence": turn("l_suppkey", "missense_variant&splice_region_variant", "synonymous_variant", "stop_gained", "", "splice_donor_variant|intron_variant", "inframe_deletion", "intergenic_variant", None, "frameshift_variant, missense_variant"),
    "context": turn("(l_orderkey + l_linenumber)", "CDS_overlap", "intron", "exon_overlap", "promoter", "intergenic", "splice_site"),
    "ref": turn("l_linenumber", "A", "ACGT"),
    "alt": turn("l_orderkey", "C", "A", "ACG"),
    "roh": "CASE WHEN l_linestatus = 'F' THEN 'yes' ELSE 'no' END",
    "zyg": "CASE WHEN l_returnflag = 'R' THEN 'hom_alt' ELSE 'het' END",
    "carriers": "CAST(l_quantity AS INT) % 14",
    "extra": "CAST(l_linenumber % 4 AS INT)",
}
_EFFECT = """, l AS (SELECT *, lower(coalesce(consequence, '')) AS q, lower(context) AS x, CAST(0 AS BIGINT) AS zero FROM i),
s AS (SELECT *, CASE WHEN q LIKE '%stop_gained%' OR q LIKE '%frameshift_variant%' OR q LIKE '%splice_donor_variant%' THEN 'very_high' WHEN q LIKE '%inframe_deletion%' THEN 'high' WHEN q LIKE '%missense_variant%' THEN 'moderate'
 WHEN q LIKE '%synonymous%' OR q LIKE '%intron_variant%' THEN 'low' WHEN q = '' AND (x LIKE '%cds%' OR x LIKE '%exon%' OR x LIKE '%splice%') THEN 'moderate' WHEN q = '' AND x LIKE '%intron%' THEN 'low' ELSE 'minimal' END AS severity,
 CASE WHEN x LIKE '%cds%' OR x LIKE '%exon%' THEN CASE WHEN var_type = 'DEL' THEN 'very_high' ELSE 'high' END WHEN x LIKE '%splice%' THEN 'high' WHEN x LIKE '%intron%' OR x LIKE '%promoter%' THEN 'moderate' ELSE 'low' END AS sv_severity,
 CASE WHEN upper(var_type) IN ('DEL', 'DUP', 'INV', 'INS', 'BND', 'TRA') THEN upper(var_type) WHEN q LIKE '%splice_%' THEN 'splice' WHEN upper(var_type) = 'INDEL' OR length(ref) <> length(alt) THEN 'small_indel' WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNP' WHEN upper(var_type) = 'SNP' THEN 'SNP' ELSE 'unknown' END AS class,
 CASE WHEN q LIKE '%splice_donor%' THEN 'essential_splice' WHEN q LIKE '%splice_region%' THEN 'splice_region' ELSE 'none' END AS splice,
 CASE WHEN zyg = 'hom_alt' AND roh = 'yes' THEN 'ZC3' WHEN zyg = 'hom_alt' THEN 'ZC2' WHEN roh = 'yes' THEN 'ZC1' ELSE 'ZC0' END AS tier FROM l),
c AS (SELECT *, concat_ws(',', CASE WHEN q LIKE '%frameshift%' THEN 'SD1' END, CASE WHEN q LIKE '%stop_gained%' THEN 'SD2' END, CASE WHEN splice = 'essential_splice' THEN 'SD3' END, CASE WHEN class IN ('DEL', 'DUP', 'INS') AND context IN ('CDS_overlap', 'exon_overlap') THEN 'SD4' END,
 CASE WHEN q LIKE '%missense%' THEN 'MD1' END, CASE WHEN q LIKE '%inframe%' THEN 'MD2' END, CASE WHEN splice = 'splice_region' THEN 'MD3' END, CASE WHEN class IN ('DEL', 'DUP', 'INS') AND x LIKE '%intron%' THEN 'MD4' END) AS codes,
 CASE WHEN carriers >= 10 THEN 'high' WHEN carriers >= 3 OR (carriers >= 1 AND severity IN ('very_high', 'high')) THEN 'medium' ELSE 'low' END AS confidence FROM s)"""


def _effects(i):
    c = F.col
    i = i.withColumn("severity", vr.small_severity(c("consequence"), c("context"))).withColumn("sv_severity", vr.structural_severity(c("context"), c("var_type")))
    i = i.withColumn("class", vr.variant_class(c("var_type"), c("ref"), c("alt"), F.lit(0), c("consequence"))).withColumn("splice", vr.splice_flag(c("consequence")))
    i = i.withColumn("tier", vr.zygosity_tier(c("zyg"), c("roh"))).withColumn("codes", vr.evidence_codes(c("class"), c("consequence"), c("splice"), c("context")))
    return i.withColumn("confidence", vr.carrier_confidence(c("carriers"), c("severity")))


@query("lineitem", EFFECTS, _EFFECT + " SELECT l_orderkey, l_linenumber, severity, sv_severity, class, splice, codes, tier, confidence FROM c")
def consequence_effects(i):
    return _effects(i).select("l_orderkey", "l_linenumber", "severity", "sv_severity", "class", "splice", F.array_join("codes", ",").alias("codes"), "tier", "confidence")


@query(
    "lineitem",
    EFFECTS,
    _EFFECT
    + """, n AS (SELECT *, (length(codes) - length(replace(codes, 'SD', ''))) // 2 AS strong, (length(codes) - length(replace(codes, 'MD', ''))) // 2 AS moderate, extra AS supportive FROM c)
SELECT l_orderkey, l_linenumber, strong AS n_strong, moderate AS n_moderate, CASE WHEN strong >= 2 OR (strong >= 1 AND confidence = 'high' AND tier = 'ZC3') OR (severity = 'very_high' AND tier = 'ZC3') OR (severity = 'very_high' AND strong >= 1 AND class IN ('DEL', 'DUP', 'INV', 'INS') AND (x LIKE '%cds%' OR x LIKE '%exon%')) THEN 'BC4'
 WHEN (strong >= 1 AND confidence IN ('high', 'medium')) OR moderate >= 2 OR (moderate >= 1 AND supportive >= 2) OR (severity IN ('very_high', 'high') AND tier IN ('ZC2', 'ZC3')) OR (severity = 'moderate' AND tier = 'ZC3') THEN 'BC3'
 WHEN moderate >= 1 OR supportive >= 3 OR (severity = 'moderate' AND confidence = 'low') OR (severity IN ('moderate', 'high') AND supportive >= 1) THEN 'BC2' WHEN supportive >= 1 OR severity = 'moderate' THEN 'BC1' ELSE 'BC0' END AS concern FROM n""",
)
def breeding_concern(i):
    c = F.col
    i = _effects(i).withColumn("codes", F.concat("codes", F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.when(k <= c("extra"), F.concat(F.lit("SU"), k.cast("string"))).otherwise(""))))
    i = i.withColumn("n", vr.evidence_counts(c("codes")))
    return i.select("l_orderkey", "l_linenumber", c("n.strong").cast("long").alias("n_strong"), c("n.moderate").cast("long").alias("n_moderate"), vr.breeding_concern(c("n.strong"), c("n.moderate"), c("n.supportive"), c("severity"), c("tier"), c("confidence"), c("class"), c("context")).alias("concern"))


@query(
    "part",
    {"p_partkey": "p_partkey", "n": "CAST(p_partkey % 260 AS INT)", "total": "CAST(100 + p_size AS INT)", "bp": "p_size * p_size * 5", "len": "CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_partkey % 700 AS INT) END"},
    """SELECT p_partkey, CASE WHEN n = 0 THEN 'absent' WHEN n = 1 THEN 'singleton' WHEN n <= 5 THEN 'rare' WHEN n <= 20 THEN 'low_frequency' WHEN n <= 80 THEN 'common' WHEN n <= 200 THEN 'widespread' ELSE 'near_fixed' END AS carriers,
 CASE WHEN n = 0 THEN 'monomorphic' WHEN n = 1 THEN 'singleton' WHEN n <= 5 THEN 'rare' WHEN n <= 20 THEN 'low_freq' WHEN n <= floor(total * 0.8) THEN 'common' ELSE 'high_freq' END AS relative,
 CASE WHEN bp < 50 THEN 'sub_SV' WHEN bp <= 500 THEN 'small' WHEN bp <= 5000 THEN 'medium' ELSE 'large' END AS length, CASE WHEN len IS NULL OR len = 0 THEN 'unknown' WHEN len <= 5 THEN 'micro' WHEN len <= 50 THEN 'small' WHEN len <= 500 THEN 'medium' ELSE 'large' END AS indel FROM i""",
)
def count_and_size_classes(i):
    c = F.col
    return i.select("p_partkey", vr.carrier_class(c("n")).alias("carriers"), vr.relative_carrier_class(c("n"), c("total")).alias("relative"), vr.length_class(c("bp")).alias("length"), vr.indel_class(c("len")).alias("indel"))


@query(
    "lineitem",
    ROW
    | {
        "annotation": turn("l_partkey", "stop_gained", "splice_acceptor_variant", "start_lost", "Missense_variant", "inframe_insertion", "splice_region", "none", None),
        "sift": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount END",
        "llr": "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE -l_quantity / 5 END",
        "effect": turn("l_suppkey", "splice_donor_5th_base", "x", "splice_branch", "splice_polypyrimidine_tract"),
        "subclass": turn("l_orderkey", "splice_donor", "splice_region", "other"),
        "best": turn("l_linenumber", "A", "B", "C"),
        "maf": "l_tax * 3",
        "n_hom": "CAST(l_quantity AS INT) % 13",
        "in_roh": "CAST(l_partkey % 2 AS INT)",
        "in_long": "CAST(l_partkey % 3 AS INT)",
    },
    """, s AS (SELECT *, lower(coalesce(annotation, '')) AS a, CAST(greatest(CASE WHEN effect = 'splice_donor_5th_base' THEN 3 ELSE 0 END, CASE WHEN effect = 'splice_branch' THEN 3 ELSE 0 END, CASE WHEN effect LIKE 'splice_poly%' THEN 2 ELSE 0 END,
 CASE WHEN subclass = 'splice_donor' AND best = 'A' THEN 4 WHEN subclass = 'splice_region' AND best IN ('A', 'B') THEN 2 ELSE 0 END) AS DOUBLE) AS splice FROM i),
t AS (SELECT *, CAST(CASE a WHEN 'stop_gained' THEN 8 WHEN 'splice_acceptor_variant' THEN 7 WHEN 'start_lost' THEN 6 WHEN 'missense_variant' THEN 4 WHEN 'inframe_insertion' THEN 2 WHEN 'splice_region' THEN 1 ELSE 0 END AS DOUBLE) + CASE WHEN sift < 0.05 THEN 4 WHEN sift < 0.1 THEN 2 ELSE 0 END + CASE WHEN llr < -7 THEN 5 WHEN llr < -3 THEN 2 ELSE 0 END + splice AS evidence,
 CASE WHEN maf < 0.01 THEN 3 WHEN maf < 0.05 THEN 2 WHEN maf < 0.20 THEN 1 ELSE 0 END + CASE WHEN n_hom >= 10 THEN 3 WHEN n_hom >= 3 THEN 2 WHEN n_hom >= 1 THEN 1 ELSE 0 END + CASE WHEN in_long > 0 THEN 3 WHEN in_roh > 0 THEN 2 ELSE 0 END AS risk FROM s)
SELECT l_orderkey, l_linenumber, evidence, risk, CASE WHEN evidence + risk >= 16 THEN 'A' WHEN evidence + risk >= 10 THEN 'B' WHEN evidence + risk >= 5 THEN 'C' ELSE 'D' END AS priority FROM t""",
)
def evidence_scores(i):
    c = F.col
    total = vr.consequence_score(c("annotation")) + vr.tolerance_score(c("sift")) + vr.likelihood_score(c("llr")) + vr.splice_score(c("effect"), c("subclass"), c("best"))
    i = i.withColumn("evidence", total).withColumn("risk", vr.hatchery_risk(c("maf"), c("n_hom"), c("in_roh"), c("in_long")))
    return i.select("l_orderkey", "l_linenumber", "evidence", "risk", vr.priority_class(c("evidence") + c("risk")).alias("priority"))


@query(
    "lineitem",
    ROW
    | {
        "pos": "l_orderkey * 1000 % 6000000",
        "a11": "CAST(l_partkey % 12 AS INT)", "h11": "CAST(l_suppkey % 3 AS INT)", "b11": "CAST(l_suppkey % 4 AS INT)",
        "a12": "CAST(l_linenumber AS INT)", "h12": "CAST(l_quantity AS INT)", "b12": "CAST(l_partkey % 3 AS INT)",
        "a22": "CAST(l_suppkey % 5 AS INT)", "h22": "CAST(l_partkey % 5 AS INT)", "b22": "CAST(l_quantity AS INT) % 20",
        "odds": "l_quantity / 2", "fdr": "l_discount",
    },
    """, n AS (SELECT *, a11 + h11 + b11 AS n11, a12 + h12 + b12 AS n12, a22 + h22 + b22 AS n22, CASE WHEN pos < 2000000 THEN 'left_flank' WHEN pos < 2500000 THEN 'left_boundary' WHEN pos < 3500000 THEN 'inversion_body' WHEN pos < 4500000 THEN 'right_boundary' ELSE 'right_flank' END AS zone,
 CASE WHEN pos < 2000000 THEN 'left_flank' WHEN pos > 4000000 THEN 'right_flank' WHEN pos <= 2000000 + 2000001 * 0.2 THEN 'left_edge' WHEN pos >= 4000000 - 2000001 * 0.2 THEN 'right_edge' ELSE 'center' END AS edge FROM i),
f AS (SELECT *, coalesce((h11 + b11) / nullif(n11, 0), 0) AS f11, coalesce((h22 + b22) / nullif(n22, 0), 0) AS f22 FROM n)
SELECT l_orderkey, l_linenumber, zone, edge, CASE WHEN n12 >= 5 AND h12 / n12 >= 0.5 AND f11 <= 0.1 AND f22 <= 0.1 THEN 'het_specific_marker' WHEN fdr >= 0.05 THEN 'uninformative'
 WHEN zone IN ('left_boundary', 'right_boundary') AND odds >= 10 AND ((f22 >= 0.7 AND f11 <= 0.1) OR (f11 >= 0.7 AND f22 <= 0.1)) THEN 'canonical_breakpoint_marker' WHEN (f22 >= 0.6 AND f11 <= 0.05) OR (f11 >= 0.6 AND f22 <= 0.05) THEN 'dominant_presence_marker'
 WHEN (n11 >= 10 AND f11 BETWEEN 0.2 AND 0.5) OR (n22 >= 10 AND f22 BETWEEN 0.2 AND 0.5) THEN 'sub_haplotype_marker' WHEN zone = 'inversion_body' AND odds >= 3 THEN 'internal_linked_marker' ELSE 'uninformative' END AS pattern FROM f""",
)
def zones_and_patterns(i):
    c = F.col
    i = i.withColumn("zone", ev.zone_of_position(c("pos"), F.lit(2_000_000), F.lit(4_000_000)))
    counts = {g: (c(f"a{g}"), c(f"h{g}"), c(f"b{g}")) for g in ("11", "12", "22")}
    return i.select("l_orderkey", "l_linenumber", "zone", ev.zone_of_midpoint(c("pos"), F.lit(2_000_000), F.lit(4_000_000)).alias("edge"), ev.pattern_label(c("zone"), counts, c("odds"), c("fdr")).alias("pattern"))


@query(
    "lineitem",
    ROW
    | {
        "lf": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity / 15 END", "lp": "l_discount * 10", "rf": "l_tax * 35", "rp": "CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE l_tax * 12 END",
        "mods": turn("l_orderkey", "conserved_boundary", "terminal_context", "", "chromosome_context_change", "conserved_boundary,other"),
        "enriched": "CAST(l_partkey % 3 AS INT)", "reversed": "CAST(l_suppkey % 4 AS INT)", "risk": "l_linenumber = 7",
    },
    """, t AS (SELECT *, coalesce(lf >= 2, FALSE) OR coalesce(lp >= 0.9, FALSE) AS a, coalesce(rf >= 2, FALSE) OR coalesce(rp >= 0.9, FALSE) AS b FROM i),
u AS (SELECT *, CASE WHEN a AND b THEN 'high' WHEN a OR b OR (lf >= 1.5 AND lf < 2 AND rf >= 1.5 AND rf < 2) THEN 'medium' ELSE 'low' END AS tier FROM t),
v AS (SELECT *, CASE WHEN risk THEN 'F' WHEN mods LIKE 'conserved%' AND reversed >= 2 THEN 'G' WHEN mods LIKE 'terminal%' THEN 'D' WHEN mods LIKE 'chromosome%' THEN 'C' WHEN tier = 'high' AND enriched >= 1 THEN 'E' ELSE 'A' END AS arch FROM u)
SELECT l_orderkey, l_linenumber, tier, arch, CASE WHEN arch = 'G' THEN 'OLD_POLY' WHEN arch = 'E' AND mods LIKE '%,%' THEN 'MULTI_AGE_HOTSPOT' WHEN arch = 'E' THEN 'OLD_BP_YOUNG_INV' WHEN arch IN ('C', 'D') THEN 'LINEAGE_KARYO' ELSE 'YOUNG_POP' END AS age,
 CASE arch WHEN 'E' THEN 'predicted_polymorphic_hotspot' WHEN 'G' THEN 'candidate_ancient_polymorphism' WHEN 'F' THEN 'interpret_with_caution_assembly_risk' ELSE 'confirmed_polymorphic_in_gar' END AS prediction, CASE WHEN tier = 'high' AND enriched >= 2 THEN 'high' WHEN tier = 'high' OR enriched >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM v""",
)
def breakpoint_fragility(i):
    c = F.col
    i = i.withColumn("tier", ev.hotspot_tier(c("lf"), c("lp"), c("rf"), c("rp"))).withColumn("m", F.filter(F.split("mods", ","), lambda x: x != ""))
    i = i.withColumn("arch", ev.architecture(c("tier"), c("m"), c("enriched"), c("reversed"), c("risk"))["arch_class"])
    return i.select("l_orderkey", "l_linenumber", "tier", "arch", ev.age_tag(c("arch"), c("tier"), c("m")).alias("age"), ev.prediction_label(c("arch")).alias("prediction"), ev.fragility_confidence(c("tier"), c("enriched")).alias("confidence"))


KEYS = ROW | {
    "a": "l_orderkey % 2 = 0", "b": "l_partkey % 3 > 0", "c": "l_suppkey % 2 = 0", "qc": turn("l_linenumber", "high", "LOW", "Moderate", None), "p": "l_discount", "odds": "l_quantity / 4",
    "verdict": turn("l_partkey", "ok", "artifact", None, "contradicted", "fine", "fine", "fine", "fine", "fine", "fine"),
    "link": turn("l_suppkey", "multi_family", "single_family", "unknown", "pca_family_confounded", "multi_family", "multi_family"), "likeness": "l_tax * 10", "jk": turn("l_linenumber", "robust", "single_family_fragile", None, "few_family", "x", "y", "z"),
    "sd": "CASE WHEN l_partkey % 4 = 3 THEN NULL ELSE l_partkey % 4 = 0 END", "ident": "80 + l_quantity / 2", "len": "l_quantity * 40", "te": turn("l_orderkey", "ENRICHED", "none", "x"), "tr": turn("l_suppkey", "enriched", "none", "x", "y"),
    "junction": turn("l_partkey", "MH_long", "blunt", "MH_short", None), "assembled": "l_linenumber < 4", "recomb": "l_discount * 8", "carriers": "CAST(l_quantity AS INT)", "lpv": "l_tax / 2", "rpv": "l_tax",
    "composite": turn("l_suppkey", "clean", "likely_composite", "clean", "maybe_composite", "clean"), "freq": "l_quantity / 50", "children": "CAST(l_linenumber % 3 AS INT)",
    "n_overlaps": "CAST(l_partkey % 3 AS INT)", "pairs": "CAST(l_suppkey % 3 AS INT)", "flanks": turn("l_orderkey", "both_coherent", "left_only", "untested", "neither", "both_coherent"), "direction": turn("l_linenumber", "inverted", "reference", None), "treeconf": turn("l_suppkey", "high", "low"),
}
_VERDICTS = """, e AS (SELECT *, CAST(a AS INT) + CAST(b AS INT) + CAST(c AND coalesce(upper(qc) IN ('HIGH', 'MODERATE'), FALSE) AS INT) + CAST(p < 0.05 AND odds > 5 AS INT) AS layers FROM i),
v AS (SELECT *, CASE WHEN verdict = 'artifact' THEN 'artifact' WHEN layers >= 3 THEN 'confirmed' WHEN layers = 2 THEN 'likely' WHEN layers = 1 THEN 'candidate' ELSE 'insufficient' END AS exists_,
 CASE WHEN link = 'pca_family_confounded' THEN 'family_confounded_fake' WHEN link = 'single_family' OR coalesce(jk, '') = 'single_family_fragile' THEN 'single_family_real' WHEN link = 'multi_family' THEN 'clean' WHEN likeness > 0.5 THEN 'family_confounded_fake' ELSE 'ambiguous' END AS family,
 CASE WHEN sd AND ident > 90 AND len > 1000 THEN 'inverted_SD_strong' WHEN sd AND ident > 85 AND len > 500 THEN 'inverted_SD_weak' WHEN te = 'ENRICHED' THEN 'TE_flanked' WHEN tr = 'enriched' THEN 'TR_rich' WHEN NOT sd THEN 'none' ELSE 'unknown' END AS substrate,
 CASE WHEN carriers < 10 THEN 'degenerate' WHEN recomb > 0.7 THEN 'complex_rearrangement_out_of_scope' WHEN recomb > 0.4 THEN 'deep_interior_recombinants' WHEN lpv < 0.01 OR rpv < 0.01 THEN 'bimodal_boundary_signal' WHEN recomb >= 0.05 THEN 'edge_recombinants_only' ELSE 'clean_simple' END AS interior,
 CASE WHEN n_overlaps = 0 THEN CASE WHEN flanks IN ('both_coherent', 'left_only') THEN 'species_specific_polymorphism' ELSE 'untested' END WHEN flanks = 'both_coherent' THEN CASE WHEN pairs >= 2 THEN 'shared_ancestral' WHEN direction IS NOT NULL AND treeconf = 'high' THEN 'ASEAN_diagnostic' ELSE 'species_specific_rearranged' END WHEN flanks IN ('left_only', 'neither') THEN 'unclassified_complex' ELSE 'untested' END AS conservation FROM e),
m AS (SELECT *, CASE WHEN substrate LIKE 'inverted%' THEN CASE WHEN assembled AND junction = 'MH_long' THEN 'NAHR_like_supported_by_assembly' ELSE 'NAHR_like_hypothesis' END
 WHEN substrate = 'none' THEN CASE WHEN assembled AND junction = 'blunt' THEN 'NHEJ_like_supported_by_assembly' WHEN assembled AND junction = 'MH_short' THEN 'MMEJ_like_supported_by_assembly' ELSE 'NHEJ_like_hypothesis' END WHEN substrate = 'TE_flanked' THEN 'TE_mediated_like_hypothesis' WHEN substrate = 'TR_rich' THEN 'MMBIR_like_hypothesis' END AS mech,
 CASE interior WHEN 'deep_interior_recombinants' THEN '_with_deep_recombinants' WHEN 'bimodal_boundary_signal' THEN '_with_partial_interior_recombination' ELSE '' END AS suffix, exists_ IN ('confirmed', 'likely') AS supported FROM v)"""


def _verdicts(i):
    c = F.col
    i = i.withColumn("e", ev.existence(c("a"), c("b"), c("c"), c("qc"), c("p"), c("odds"), c("verdict"))).withColumn("family", ev.family_verdict(c("link"), c("likeness"), c("jk")))
    i = i.withColumn("substrate", ev.substrate_verdict(c("sd"), c("ident"), c("len"), c("te"), c("tr"))).withColumn("m", ev.mechanism(c("substrate"), c("junction"), c("assembled")))
    i = i.withColumn("interior", ev.interior_class(c("recomb"), c("carriers"), c("lpv"), c("rpv")))
    return i.withColumn("conservation", ev.conservation_class(c("n_overlaps"), c("pairs"), c("flanks"), c("direction"), c("treeconf")))


@query("lineitem", KEYS, _VERDICTS + " SELECT l_orderkey, l_linenumber, exists_ AS existence, layers, family, substrate, mech AS mechanism, interior, conservation FROM m")
def evidence_verdicts(i):
    c = F.col
    return _verdicts(i).select("l_orderkey", "l_linenumber", c("e.verdict").alias("existence"), "e.layers", "family", "substrate", F.concat("m.mechanism", "m.suffix").alias("mechanism"), "interior", "conservation")


@query(
    "lineitem",
    KEYS,
    _VERDICTS
    + """ SELECT l_orderkey, l_linenumber, CASE WHEN interior = 'complex_rearrangement_out_of_scope' THEN interior WHEN verdict = 'contradicted' THEN 'contradicted_candidate' WHEN exists_ = 'artifact' OR family = 'family_confounded_fake' THEN 'family_confounded_locus'
 WHEN family = 'single_family_real' AND supported THEN 'single_family_polymorphism' WHEN composite = 'likely_composite' THEN 'complex_unresolved_locus' WHEN exists_ = 'insufficient' THEN 'candidate_weak_evidence' WHEN NOT a AND b AND freq > 0.85 THEN 'supported_fixed_inversion_SV_only'
 WHEN conservation IN ('shared_ancestral', 'ASEAN_diagnostic') AND supported THEN 'supported_shared_between_species_inversion' || suffix WHEN children = 1 AND supported THEN 'supported_nested_inversion' WHEN supported AND mech IS NOT NULL THEN 'supported_balanced_inversion_' || mech || suffix
 WHEN supported THEN 'supported_balanced_inversion_simple' || suffix WHEN exists_ = 'candidate' THEN 'candidate_weak_evidence' ELSE 'supported_locus_unreconstructed' END AS label FROM m""",
)
def structural_labels(i):
    c = F.col
    return _verdicts(i).select("l_orderkey", "l_linenumber", ev.structural_label(c("interior"), c("verdict"), c("e.verdict"), c("family"), c("composite"), c("a"), c("b"), c("freq"), c("conservation"), c("children"), c("substrate"), c("m")).alias("label"))


@query(
    "lineitem",
    ROW
    | {
        "current": turn("l_orderkey", "NONE", "UNCERTAIN", "SUPPORTED", "VALIDATED", "", None), "conc": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_quantity / 50 END",
        "old": turn("l_suppkey", "robust", "fragile", None, "robust"), "jk": turn("l_partkey", "robust_multi_family", "few_family", "Single_family_fragile", "pca_family_driven", None, "multi_family_contributing", "fragile"),
        "delta": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax * 5 END", "p": "l_discount", "odds": "l_quantity / 4", "cap": turn("l_linenumber", None, "UNCERTAIN", None, None),
    },
    """, e AS (SELECT *, CASE coalesce(current, '') WHEN 'NONE' THEN 0 WHEN 'SUPPORTED' THEN 2 WHEN 'VALIDATED' THEN 3 ELSE 1 END AS now, CASE WHEN p < 0.05 AND odds > 5 THEN 3 ELSE -2 END AS fisher, lower(coalesce(jk, '')) AS j FROM i),
g AS (SELECT *, greatest(now, fisher, CASE WHEN conc >= 0.7 AND old = 'robust' THEN 2 ELSE -2 END) AS one, least(greatest(now, fisher, CASE WHEN conc >= 0.7 AND j IN ('robust_multi_family', 'few_family', 'single_family_fragile') THEN 2 ELSE -2 END), CASE WHEN cap = 'UNCERTAIN' THEN 1 ELSE 3 END, CASE WHEN j IN ('few_family', 'single_family_fragile') OR (j = '' AND delta > 0.3) THEN 2 ELSE 3 END) AS two FROM e)
SELECT l_orderkey, l_linenumber, CASE WHEN old = 'fragile' OR delta > 0.3 THEN 'SUSPECT' ELSE ['NONE', 'UNCERTAIN', 'SUPPORTED', 'VALIDATED'][one + 1] END AS simple, CASE WHEN j IN ('fragile', 'pca_family_driven') THEN 'SUSPECT' ELSE ['NONE', 'UNCERTAIN', 'SUPPORTED', 'VALIDATED'][two + 1] END AS capped,
 CASE j WHEN 'multi_family_contributing' THEN 'partial_robustness' WHEN 'few_family' THEN 'restricted_family_spread' WHEN 'single_family_fragile' THEN 'family_specific_polymorphism' WHEN 'pca_family_driven' THEN 'pca_groups_family_confounded' WHEN 'fragile' THEN 'pca_groups_family_confounded' ELSE CASE WHEN j = '' AND delta > 0.3 THEN 'high_jackknife_delta_no_verdict' ELSE 'normal' END END AS flags,
 CASE j WHEN 'robust_multi_family' THEN 'multi_family' WHEN 'multi_family_contributing' THEN 'multi_family' WHEN 'few_family' THEN 'few_family' WHEN 'single_family_fragile' THEN 'single_family' WHEN 'pca_family_driven' THEN 'pca_family_confounded' WHEN 'fragile' THEN 'pca_family_confounded' ELSE CASE WHEN j = '' AND delta > 0.3 THEN 'uncertain' ELSE 'unknown' END END AS linkage FROM g""",
)
def validation_levels(i):
    c = F.col
    simple = ev.validation_level(c("current"), c("conc"), c("old"), c("delta"), c("p"), c("odds"))
    i = i.withColumn("v", ev.capped_validation(c("current"), c("conc"), c("jk"), c("delta"), c("p"), c("odds"), c("cap")))
    return i.select("l_orderkey", "l_linenumber", simple.alias("simple"), c("v.level").alias("capped"), "v.flags", "v.linkage")


@query(
    "lineitem",
    ROW | {f"x{k}": f"CASE WHEN (l_orderkey + l_linenumber) % {3 + k} = 0 THEN NULL ELSE {e} END" for k, e in enumerate(["l_quantity / 40", "l_quantity / 18", "l_discount * 12", "l_tax * 14", "l_extendedprice / 20000", "l_tax * 20"])},
    """, f AS (SELECT *, coalesce(x0 <= 0.5, FALSE) AS a, coalesce(x1 >= 2, FALSE) AS b, coalesce(x2 <= 0.6 AND x3 <= 0.7, FALSE) AS c FROM i)
SELECT l_orderkey, l_linenumber, CASE WHEN CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) >= 2 THEN 'messy' WHEN c THEN 'coverage_artifact' WHEN b THEN 'high_uncertain' WHEN a THEN 'low_snp' WHEN coalesce(x4 >= 2, FALSE) OR coalesce(x5 >= 1.3, FALSE) THEN 'clean' ELSE 'unknown' END AS shelf,
 CASE WHEN x0 > 0.5 THEN 'ASSEMBLY_GAP' WHEN x2 > 0.5 THEN 'REPEAT_RICH' WHEN x4 IS NOT NULL AND x1 > 2 THEN 'LOW_MAPPABILITY' ELSE 'DROPOUT' END AS gap,
 CASE WHEN x0 > 0.2 OR x3 > 0.2 THEN 'likely_composite' WHEN x0 >= 0.05 OR x3 >= 0.05 OR x2 >= 0.2 THEN 'maybe_composite' WHEN x4 >= 0.8 THEN 'clean' ELSE 'maybe_composite' END AS composite,
 CASE WHEN x0 < x3 THEN 'clean_background' WHEN x1 > 1 + x3 THEN 'family_ld_band' WHEN x0 > 3 * x3 THEN 'extended_suppression' ELSE 'transition_zone' END AS between_blocks FROM f""",
)
def quality_shelves(i):
    x = [F.col(f"x{k}") for k in range(6)]
    return i.select("l_orderkey", "l_linenumber", ev.shelf_flag(*x).alias("shelf"), ev.gap_flag(x[0], x[2], x[4], x[1] * 25).alias("gap"), ev.composite_flag(F.lit(1), x[0], x[3], x[2], x[4]).alias("composite"), ev.gap_category(x[0], x[1], F.lit(1), x[3]).alias("between_blocks"))


@query(
    "lineitem",
    ROW | {"n": "CAST(l_quantity AS INT)", "ratio": "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity / 20 END", "old": "l_extendedprice / 20000", "dxy": "l_tax / 100", "asym": "l_discount * 15", "pd": "l_quantity / 25", "pf": "l_discount * 18", "u": "l_extendedprice / 30000", "bp": "l_tax * 25", "flat": "l_discount * 7", "comp": turn("l_suppkey", "likely_composite", "maybe_composite", "clean")},
    """, h AS (SELECT *, list_filter([CASE WHEN asym >= 1 THEN 'asymmetric_edge' END, CASE WHEN pd >= 1.5 OR pf >= 1.5 THEN 'locally_adapted_internal_peak_like' END, CASE WHEN u >= 1.5 AND pd < 1.5 THEN 'neutral_like_U_shape' END, CASE WHEN bp >= 1.5 AND u < 1.5 THEN 'locally_adapted_breakpoint_like' END, CASE WHEN ratio >= 1.5 AND flat <= 0.35 THEN 'flat_high_deep_structural_haplotype' END], lambda x: x IS NOT NULL) AS hits FROM i)
SELECT l_orderkey, l_linenumber, CASE WHEN ratio IS NULL OR n < 8 THEN 'insufficient_data' WHEN old < 1.2 OR dxy < 0.0001 THEN 'young_weak_divergence' WHEN len(hits) = 0 OR len(hits) >= 3 THEN 'complex_mixed' ELSE hits[1] END AS primary_class,
 CASE WHEN ratio IS NULL OR n < 8 OR old < 1.2 OR dxy < 0.0001 THEN NULL ELSE hits[2] END AS secondary_class, coalesce(nullif(concat_ws(',', CASE comp WHEN 'likely_composite' THEN 'composite_cap' WHEN 'maybe_composite' THEN 'maybe_composite_flagged' END, CASE WHEN flat < 0.25 THEN 'low_silhouette' END, CASE WHEN dxy < 0.05 THEN 'weak_k3_fit' END, CASE WHEN old < 0.3 THEN 'low_phase' END), ''), 'normal') AS flags FROM h""",
)
def shape_classes(i):
    c = F.col
    i = i.withColumn("s", ev.shape_class(c("n"), c("ratio"), c("old"), c("dxy"), c("asym"), c("pd"), c("pf"), c("u"), c("bp"), c("flat")))
    return i.select("l_orderkey", "l_linenumber", c("s.primary").alias("primary_class"), c("s.secondary").alias("secondary_class"), ev.quality_flags(c("comp"), c("flat"), c("dxy"), c("old"))["flags"].alias("flags"))


@query(
    "lineitem",
    ROW | {"alt": turn("l_partkey", "]c:1]A", "A[c:1[", "A]c:1]", "[c:1[A", "<DEL>", "ACG"), "mm": turn("l_suppkey", "NAHR_CANDIDATE", "NAHR_POSSIBLE", "NHEJ_CANDIDATE", "COMPLEX_ARCHITECTURE", None), "b2": turn("l_orderkey", "strong", "weak", "subthreshold", "direct_only", "none", None, ""), "b3": turn("l_linenumber", "strong", "none", "subthreshold"), "g": turn("l_linenumber", "0/0", "./.", "0/1")},
    """, k AS (SELECT *, CASE WHEN mm IS NULL AND coalesce(b2, '') = '' THEN 'no_data low UNCERTAIN' WHEN mm IS NULL THEN CASE WHEN b2 IN ('strong', 'weak') THEN 'biser2_only_nahr medium NAHR' ELSE 'biser2_only_nhej medium NHEJ' END WHEN mm = 'COMPLEX_ARCHITECTURE' THEN 'complex_flagged low COMPLEX'
 WHEN coalesce(b2, '') = '' THEN CASE WHEN mm LIKE 'NAHR%' THEN 'minimap2_only_nahr medium NAHR' ELSE 'minimap2_only_nhej medium NHEJ' END WHEN mm = 'NAHR_CANDIDATE' THEN CASE WHEN b2 IN ('strong', 'weak') THEN 'agree_nahr high NAHR' WHEN b2 = 'subthreshold' THEN 'minimap2_stronger_nahr medium NAHR' ELSE 'disagree_biser2_missing high NAHR' END
 WHEN mm = 'NAHR_POSSIBLE' THEN CASE WHEN b2 IN ('strong', 'weak') THEN 'agree_nahr_weak medium NAHR' WHEN b2 = 'subthreshold' THEN 'agree_nahr_weak low NAHR' ELSE 'minimap2_only_weak low NAHR' END ELSE CASE WHEN b2 IN ('strong', 'weak') THEN 'disagree_minimap2_missing medium UNCERTAIN' WHEN b2 = 'subthreshold' THEN 'agree_nhej medium NHEJ' ELSE 'agree_nhej high NHEJ' END END AS t FROM i)
SELECT l_orderkey, l_linenumber, CASE alt WHEN ']c:1]A' THEN NULL WHEN 'A[c:1[' THEN '5to5' WHEN 'A]c:1]' THEN '3to5' END AS orientation, CASE alt WHEN ']c:1]A' THEN '3to3' WHEN 'A[c:1[' THEN '5to5' WHEN 'A]c:1]' THEN '3to5' WHEN '[c:1[A' THEN '5to3' ELSE 'unknown' END AS by_index, split_part(t, ' ', 1) AS concordance, split_part(t, ' ', 2) AS confidence, split_part(t, ' ', 3) AS call, g = '0/1' AS polymorphic FROM k""",
)
def breakends_and_substrates(i):
    c = F.col
    i = i.withColumn("k", ev.substrate_concordance(c("mm"), c("b2")))
    return i.select("l_orderkey", "l_linenumber", ev.breakend_orientation(c("alt")).alias("orientation"), ev.breakend_orientation_by_index(c("alt")).alias("by_index"), "k.concordance", "k.confidence", "k.call", ev.is_polymorphic(F.array(c("g"), F.lit("."))).alias("polymorphic"))
