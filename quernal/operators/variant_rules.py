"""Rule tables for variant calls: rescue, final class, marker class, severity, concern, scores.

Every rule is a Column over Columns, so a whole cascade is one projection inside
whole-stage codegen.  A comparison with a missing value fails, as in
`rules.first_match`, unless a rule says that a missing value passes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_match, only_if_present

INDELS = ("INS", "DEL")
CALLED = ("HET", "HOM_VAR")
STRUCTURAL = ("DEL", "DUP", "INV", "INS")


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def pick(rules: list[tuple], fields: tuple[str, ...], otherwise: tuple) -> Column:
    """A struct: of each rule (condition, value, value, ...) that holds first, its values."""

    def row(values):
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(fields, values, strict=True)])

    out = F
    for condition, *values in rules:
        out = out.when(holds(condition), row(values))
    return out.otherwise(row(otherwise))


def has(text: Column, *words: str) -> Column:
    """Whether the lower-cased text has one of the words anywhere."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


# Calls.


def genotype_code(gt: Column) -> Column:
    """AA, AB, BB or miss; every called pair that is not 0/0 or 1/1 is AB."""
    parts = F.split(F.coalesce(gt, F.lit(".")), "[/|]")
    a, b = parts[0].try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    return first_match([((F.size(parts) != 2) | a.isNull() | b.isNull(), "miss"), ((a == 0) & (b == 0), "AA"), ((a == 1) & (b == 1), "BB")], "AB")


def call_dosage(gt: Column) -> Column:
    """Copies of allele 1 in a diploid call of alleles 0 and 1; half calls and others are null."""
    pair = F.array_sort(F.split(gt, "[/|]"))
    return F.when(pair == F.array(F.lit("0"), F.lit("0")), 0).when(pair == F.array(F.lit("0"), F.lit("1")), 1).when(pair == F.array(F.lit("1"), F.lit("1")), 2)


def call_presence(gt: Column) -> Column:
    """1 for a carrier, 0 for none, null for half calls and others."""
    return (call_dosage(gt) > 0).cast("int")


def caller_source(p: Column, f: Column) -> Column:
    p, f = holds(p), holds(f)
    return first_match([(p & f, "PF"), (p, "P"), (f, "F")], "NONE")


# Rescue.  Fixed values: least quality, depth, allele fraction and alternative reads of each branch.
RESCUE = {"strong_indel": (8, 4, 0.25, 2), "relaxed_indel": (5, 3, 0.15, 1), "strong_snp_q12": (12, 3, 0.15, 1)}
LEAST_GQ = 5


def reaches(branch: str, qual: Column, dp: Column, af: Column, ad_alt: Column) -> Column:
    return holds((qual >= RESCUE[branch][0]) & (dp >= RESCUE[branch][1]) & (af >= RESCUE[branch][2]) & (ad_alt >= RESCUE[branch][3]))


def rescue(var_type: Column, status: Column, gt_class: Column, qual: Column, dp: Column, af: Column, ad_alt: Column, gq: Column) -> Column:
    """Final class, layer and reason of a call: passed, rescued by one of three branches, or pending."""
    filtered, called = status == "FILTERED", gt_class.isin(*CALLED)
    evidence = (qual, dp, af, ad_alt)
    kept = ("RESCUED_STRONG_SINGLE_SAMPLE", "relaxed_marker")
    return pick(
        [
            (status == "PASS", "STRICT_PASS", "strict_marker", "pass"),
            (filtered & var_type.isin(*INDELS) & reaches("strong_indel", *evidence) & only_if_present(gq, gq >= LEAST_GQ), *kept, "strong_indel"),
            (filtered & var_type.isin(*INDELS) & called & reaches("relaxed_indel", *evidence), *kept, "relaxed_indel"),
            (filtered & (var_type == "SNP") & called & reaches("strong_snp_q12", *evidence), *kept, "strong_snp_q12"),
        ],
        ("final_class", "layer", "reason"),
        ("PENDING", "pending", "none"),
    )


def final_class(current: Column, layer: Column, reason: Column, is_indel: Column, confirmed: Column, weak: Column, in_block: Column, overlapping: Column) -> Column:
    """What becomes of a call once population keys and local blocks are known."""
    pending = current == "PENDING"
    return pick(
        [
            (current == "STRICT_PASS", "STRICT_PASS", "strict_marker", "pass"),
            (current == "RESCUED_STRONG_SINGLE_SAMPLE", current, "relaxed_marker", F.coalesce(reason, F.lit("strong_single_sample"))),
            (pending & is_indel & holds(confirmed), "RESCUED_POPULATION_SIGNATURE", "rescued_population_marker", "population_regenotype"),
            (pending & is_indel & holds(weak), "WEAK_SIGNATURE_CANDIDATE", "weak_signature_candidate", "weak_candidate"),
            (pending & in_block & overlapping, "COMPLEX_LOCAL_BLOCK_ONLY", "complex_block_only", "complex_block"),
            (pending, "FILTERED_DISCARD", "discard", "none"),
        ],
        ("final_class", "layer", "reason"),
        (current, F.coalesce(layer, F.lit("discard")), F.coalesce(reason, F.lit("none"))),
    )


MARKER_FIELDS = ("marker_class", "subclass", "assay", "priority", "confidence", "deployment", "direct_assay")
# The levels (priority, confidence, deployment, direct assay) that go together.
HIGH, MEDIUM_IF, MEDIUM, LOW_IF = ("high", "high", "deployable", "yes"), ("medium", "medium", "candidate", "conditional"), ("medium", "medium", "candidate", "yes"), ("low", "low", "candidate", "conditional")


def marker_class(final: Column, var_type: Column, reason: Column, qual: Column, dp: Column, af: Column, n_local: Column, indel_len: Column) -> Column:
    """Class A (deployable) to E (not recommended) of a marker, with assay and levels.

    A passed SNP, insertion or deletion that misses its thresholds is exploratory (D);
    only other passed types count as passed in a messy context (B).
    """
    passed, rescued = final == "STRICT_PASS", final == "RESCUED_STRONG_SINGLE_SAMPLE"
    snp, indel = var_type == "SNP", var_type.isin(*INDELS)
    clean = (qual >= 30) & (dp >= 5) & (af >= 0.2) & (n_local <= 2)
    solid = (qual >= 10) & (dp >= 4) & (af >= 0.25) & (n_local <= 3)
    q12 = snp & F.contains(F.coalesce(reason, F.lit("")), F.lit("snp_q12"))
    either = F.when(indel, "direct_indel").otherwise("direct_SNP")
    return pick(
        [
            (passed & snp & clean, "A", "direct_snp_high_conf", "direct_SNP", *HIGH),
            (passed & indel & clean & (indel_len <= 30), "A", "direct_indel_high_conf", "direct_indel", *HIGH),
            (passed & indel & clean & (indel_len <= 100), "B", "direct_indel_medium", "direct_indel", *MEDIUM_IF),
            (passed & ~(snp | indel), "B", "pass_messy_context", "direct_indel", *MEDIUM_IF),
            (rescued & q12 & (qual >= 15) & (dp >= 4) & (n_local <= 3), "B", "rescued_snp_strong", "direct_SNP", *MEDIUM),
            (rescued & q12, "C", "rescued_snp_conditional", "direct_SNP", *LOW_IF),
            (rescued & indel & solid & (indel_len <= 30), "B", "rescued_indel_strong", "direct_indel", *MEDIUM_IF),
            (rescued & indel & solid, "C", "rescued_indel_large", "direct_indel", *LOW_IF),
            (rescued & indel, "C", "rescued_indel_weak", "direct_indel", *LOW_IF),
            (final == "RESCUED_POPULATION_SIGNATURE", "C", "population_rescued", either, *LOW_IF),
            (final == "WEAK_SIGNATURE_CANDIDATE", "D", "weak_candidate", "exploratory_only", "none", "very_low", "exploratory_only", "no"),
            (final.isin("FILTERED_DISCARD", "COMPLEX_LOCAL_BLOCK_ONLY"), "E", "not_recommended", "not_recommended", "none", "none", "not_recommended", "no"),
        ],
        MARKER_FIELDS,
        ("D", "exploratory_only", "exploratory_only", "low", "low", "exploratory_only", "unknown"),
    )


def notes(flags: dict[str, Column], otherwise: str, joint: str = "; ") -> Column:
    """The names of the flags that hold, joined; `otherwise` if none does."""
    named = F.array_join(F.array_compact(F.array(*[F.when(holds(c), F.lit(n)) for n, c in flags.items()])), joint)
    return F.when(named == "", F.lit(otherwise)).otherwise(named)


def primer_feasibility(var_type: Column, indel_len: Column, near10: Column, near20: Column, overlapping: Column) -> Column:
    assay = first_match([(var_type == "SNP", "KASP_or_TaqMan"), (indel_len <= 5, "KASP_or_fragment_analysis"), (indel_len <= 30, "fragment_analysis")], "gel_or_capillary")
    yes = lambda c: F.when(holds(c), "yes").otherwise("no")
    caution = notes({"high_local_variant_density": near10 > 2, "large_indel": indel_len > 50, "overlapping_events": overlapping}, "none")
    return F.struct(assay.alias("assay"), yes((near10 <= 1) & (near20 <= 3)).alias("easy"), yes((near10 > 3) | (near20 > 6)).alias("hard"), caution.alias("caution"))


# Consequences.

SEVERITIES = ["minimal", "low", "moderate", "high", "very_high"]
# Consequence terms by severity; terms that are not here are minimal.
TERMS = {
    "very_high": "stop_gained frameshift_variant start_lost splice_donor_variant splice_acceptor_variant transcript_ablation feature_truncation",
    "high": "stop_lost initiator_codon_variant inframe_insertion inframe_deletion disruptive_inframe_insertion disruptive_inframe_deletion protein_altering_variant",
    "moderate": "missense_variant splice_region_variant incomplete_terminal_codon_variant coding_sequence_variant",
    "low": "synonymous_variant 5_prime_utr_variant 3_prime_utr_variant non_coding_transcript_exon_variant intron_variant nmd_transcript_variant",
}


def small_severity(consequence: Column, context: Column) -> Column:
    """The worst severity of the terms (separated by & | or comma); without terms, by the feature's context."""
    low = F.lower(F.coalesce(consequence, F.lit("")))
    terms = F.transform(F.split(low, "[&|,]"), lambda term: F.trim(term))
    known = [(F.arrays_overlap(terms, F.array(*map(F.lit, names.split()))), level) for level, names in TERMS.items()]
    bare = low.isin("", ".", "none", "nan")
    return first_match([*known, (bare & has(context, "cds", "exon", "splice"), "moderate"), (bare & has(context, "intron"), "low")], "minimal")


def structural_severity(context: Column, sv_type: Column) -> Column:
    coding = has(context, "cds", "exon")
    return first_match([(coding & (F.upper(sv_type) == "DEL"), "very_high"), (coding | has(context, "splice"), "high"), (has(context, "intron", "gene", "promoter"), "moderate")], "low")


def variant_class(var_type: Column, ref: Column, alt: Column, indel_len: Column, consequence: Column) -> Column:
    """Structural type first, then splice, small indel, SNP."""
    kind, r, a = F.upper(F.coalesce(var_type, F.lit(""))), F.length(ref), F.length(alt)
    structural = kind.isin(*STRUCTURAL, "BND", "TRA")
    rest = first_match(
        [
            (has(consequence, "splice_donor", "splice_acceptor", "splice_region"), "splice"),
            (kind.isin("INDEL", "MNP") | ((r != a) & (r <= 50) & (a <= 50)), "small_indel"),
            ((r == 1) & (a == 1), "SNP"),
            (F.abs(indel_len) > 0, "small_indel"),
            (kind == "SNP", "SNP"),
        ],
        "unknown",
    )
    return F.when(structural, kind).otherwise(rest)


def splice_flag(consequence: Column) -> Column:
    return first_match([(has(consequence, "splice_donor", "splice_acceptor"), "essential_splice"), (has(consequence, "splice_region"), "splice_region")], "none")


def evidence_codes(kind: Column, consequence: Column, splice: Column, context: Column) -> Column:
    """Array of strong (SD) and moderate (MD) evidence codes."""
    structural = kind.isin(*STRUCTURAL)
    flags = {
        "SD1": has(consequence, "frameshift"),
        "SD2": has(consequence, "stop_gained"),
        "SD3": splice == "essential_splice",
        "SD4": structural & context.isin("CDS_overlap", "exon_overlap"),
        "MD1": has(consequence, "missense"),
        "MD2": has(consequence, "inframe"),
        "MD3": splice == "splice_region",
        "MD4": structural & has(context, "intron"),
    }
    return F.array_compact(F.array(*[F.when(holds(c), F.lit(n)) for n, c in flags.items()]))


def evidence_counts(codes: Column) -> Column:
    """How many different strong, moderate and supportive codes (SD, MD, SU 1 to 7) the array has."""
    of = lambda kind: F.size(F.array_intersect(codes, F.array(*[F.lit(f"{kind}{i}") for i in range(1, 8)])))
    return F.struct(of("SD").alias("strong"), of("MD").alias("moderate"), of("SU").alias("supportive"))


def zygosity_tier(zygosity: Column, in_roh: Column) -> Column:
    hom, roh = zygosity == "hom_alt", in_roh == "yes"
    return first_match([(hom & roh, "ZC3"), (hom, "ZC2"), (roh, "ZC1")], "ZC0")


def carrier_confidence(n_carriers: Column, severity: Column) -> Column:
    return first_match([(n_carriers >= 10, "high"), (n_carriers >= 3, "medium"), ((n_carriers >= 1) & severity.isin("very_high", "high"), "medium")], "low")


def breeding_concern(strong: Column, moderate: Column, supportive: Column, severity: Column, tier: Column, confidence: Column, kind: Column, context: Column) -> Column:
    """BC4 (strong caution) to BC0, the highest level one of whose grounds holds."""
    sure = confidence == "high"
    grounds = {
        "BC4": [strong >= 2, (strong >= 1) & sure & (tier == "ZC3"), (severity == "very_high") & ((tier == "ZC3") | (kind.isin(*STRUCTURAL) & has(context, "cds", "exon") & (strong >= 1)))],
        "BC3": [(strong >= 1) & (sure | (confidence == "medium")), moderate >= 2, (moderate >= 1) & (supportive >= 2), severity.isin("very_high", "high") & tier.isin("ZC2", "ZC3"), (severity == "moderate") & (tier == "ZC3")],
        "BC2": [moderate >= 1, supportive >= 3, (severity == "moderate") & (confidence == "low"), severity.isin("moderate", "high") & (supportive >= 1)],
        "BC1": [supportive >= 1, severity == "moderate"],
    }
    return first_match([(c, level) for level, cs in grounds.items() for c in cs], "BC0")


# Classes by count and size.  Fixed values: the bounds and their names.


def carrier_class(n: Column) -> Column:
    return first_match([(n == 0, "absent"), (n == 1, "singleton"), (n <= 5, "rare"), (n <= 20, "low_frequency"), (n <= 80, "common"), (n <= 200, "widespread"), (n > 200, "near_fixed")], "unknown")


def relative_carrier_class(n: Column, total: Column) -> Column:
    return first_match([(n == 0, "monomorphic"), (n == 1, "singleton"), (n <= 5, "rare"), (n <= 20, "low_freq"), (n <= F.floor(total * 0.8), "common")], "high_freq")


def length_class(bp: Column) -> Column:
    return first_match([(bp < 50, "sub_SV"), (bp <= 500, "small"), (bp <= 5000, "medium")], "large")


def indel_class(length: Column) -> Column:
    return first_match([(length.isNull() | (length == 0), "unknown"), (length <= 5, "micro"), (length <= 50, "small"), (length <= 500, "medium")], "large")


# Scores.  Fixed values: points unless a weight of that name is given.
POINTS = {"stop_gained": 8, "splice_acceptor": 7, "start_lost": 6, "stop_lost": 5, "missense": 4, "inframe_insertion": 2, "splice_region": 1, "deleterious": 4, "borderline": 2, "likely_damaging": 5, "possibly_damaging": 2, "donor_5th_base": 3, "branch_point": 3, "polypyrimidine": 2, "class_A": 4, "class_B": 2}
PRIORITY = [(16, "A"), (10, "B"), (5, "C")]
MOST_SPLICE = 5


def _points(rules: list[tuple[Column, str]], weights: dict[str, float] | None) -> Column:
    points = POINTS | (weights or {})
    out = F
    for condition, name in rules:
        out = out.when(holds(condition), F.lit(float(points[name])))
    return out.otherwise(0.0)


def consequence_score(annotation: Column, weights: dict[str, float] | None = None) -> Column:
    return _points(
        [(has(annotation, "stop_gained", "frameshift"), "stop_gained"), (has(annotation, "splice_acceptor", "splice_donor"), "splice_acceptor"), (has(annotation, "start_lost"), "start_lost"), (has(annotation, "stop_lost"), "stop_lost"), (has(annotation, "missense"), "missense"), (has(annotation, "inframe"), "inframe_insertion"), (has(annotation, "splice_region"), "splice_region")],
        weights,
    )


def tolerance_score(sift: Column, weights: dict[str, float] | None = None) -> Column:
    return _points([(sift < 0.05, "deleterious"), (sift < 0.1, "borderline")], weights)


def likelihood_score(llr: Column, weights: dict[str, float] | None = None) -> Column:
    return _points([(llr < -7, "likely_damaging"), (llr < -3, "possibly_damaging")], weights)


def splice_score(effect: Column, subclass: Column, priority: Column, weights: dict[str, float] | None = None) -> Column:
    """The best of the splice bonuses, at most MOST_SPLICE."""
    one = lambda c, n: _points([(c, n)], weights)
    by_class = _points([(subclass.isin("splice_donor", "splice_acceptor") & (priority == "A"), "class_A"), ((subclass == "splice_region") & priority.isin("A", "B"), "class_B")], weights)
    best = F.greatest(one(has(effect, "splice_donor_5th_base"), "donor_5th_base"), one(has(effect, "splice_branch"), "branch_point"), one(has(effect, "splice_polypyrimidine"), "polypyrimidine"), by_class)
    return F.least(best, F.lit(float(MOST_SPLICE)))


def priority_class(total: Column, steps: list[tuple[float, str]] = PRIORITY) -> Column:
    return first_match([(total >= bound, label) for bound, label in steps], "D")


def hatchery_risk(maf: Column, n_hom: Column, n_hom_in_roh: Column, n_hom_in_long_roh: Column) -> Column:
    """Points for rarity, homozygotes, and homozygotes within (long) runs of homozygosity."""
    rarity = F.when(maf < 0.01, 3).when(maf < 0.05, 2).when(maf < 0.20, 1).otherwise(0)
    homs = F.when(n_hom >= 10, 3).when(n_hom >= 3, 2).when(n_hom >= 1, 1).otherwise(0)
    runs = F.when(n_hom_in_long_roh > 0, 3).when(n_hom_in_roh > 0, 2).otherwise(0)
    return rarity + homs + runs
