"""Rule tables for evidence: zones, patterns, verdicts, structural labels, validation, quality flags.

As in `variant_rules`, every table is a Column over Columns, and a comparison
with a missing value fails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_match
from .variant_rules import has, holds, notes, pick

ZONES = ["left_flank", "left_boundary", "inversion_body", "right_boundary", "right_flank"]
#: Half width of a boundary zone where no zones are given.
BOUNDARY_BP = 500_000


def zone_of_position(pos: Column, left: Column, right: Column, zones: dict[str, tuple[Column, Column]] | None = None) -> Column:
    """The first given zone (ends included) with the position; else by distance to the boundaries."""
    given = [(pos.between(*zones[z]), z) for z in ZONES if zones and z in zones]
    return first_match([*given, (pos < left, ZONES[0]), (pos < left + BOUNDARY_BP, ZONES[1]), (pos < right - BOUNDARY_BP, ZONES[2]), (pos < right + BOUNDARY_BP, ZONES[3])], ZONES[4])


def zone_of_midpoint(mid: Column, start: Column, end: Column, edge_fraction: float = 0.20) -> Column:
    edge = (end - start + 1) * edge_fraction
    return first_match([(mid < start, "left_flank"), (mid > end, "right_flank"), (mid <= start + edge, "left_edge"), (mid >= end - edge, "right_edge")], "center")


def relative_position(pos: Column, start: Column, end: Column) -> Column:
    """Where a position lies between two ends, held to 0..1; 0.5 for an empty range."""
    return F.when(end > start, F.least(F.greatest((pos - start) / (end - start), F.lit(0.0)), F.lit(1.0))).otherwise(0.5)


def carrier_share(ab: Column, bb: Column, aa: Column) -> Column:
    return F.coalesce((ab + bb) / F.nullif(aa + ab + bb, F.lit(0)), F.lit(0.0))


def pattern_label(zone: Column, counts: dict[str, tuple[Column, Column, Column]], odds_ratio: Column, fdr: Column, cutoff: float = 0.05) -> Column:
    """Marker pattern from (AA, AB, BB) counts of the groups 11, 12 and 22.

    A marker of heterozygotes alone shows no contrast between homozygotes, so it
    is looked for before the test's cutoff applies.
    """
    n = {g: a + h + b for g, (a, h, b) in counts.items()}
    f = {g: carrier_share(h, b, a) for g, (a, h, b) in counts.items()}
    x, y = f["11"], f["22"]
    apart = lambda most, least: ((y >= most) & (x <= least)) | ((x >= most) & (y <= least))
    return first_match(
        [
            ((n["12"] >= 5) & (counts["12"][1] / F.nullif(n["12"], F.lit(0)) >= 0.5) & (x <= 0.1) & (y <= 0.1), "het_specific_marker"),
            (fdr >= cutoff, "uninformative"),
            (zone.isin(ZONES[1], ZONES[3]) & (odds_ratio >= 10) & apart(0.7, 0.1), "canonical_breakpoint_marker"),
            (apart(0.6, 0.05), "dominant_presence_marker"),
            (((n["11"] >= 10) & x.between(0.2, 0.5)) | ((n["22"] >= 10) & y.between(0.2, 0.5)), "sub_haplotype_marker"),
            ((zone == ZONES[2]) & (odds_ratio >= 3), "internal_linked_marker"),
        ],
        "uninformative",
    )


# Fragility of breakpoints.


def hotspot_tier(left_fold: Column, left_percentile: Column, right_fold: Column, right_percentile: Column) -> Column:
    high = lambda fold, pct: holds(fold >= 2.0) | holds(pct >= 0.90)
    middle = lambda fold: holds((fold >= 1.5) & (fold < 2.0))
    a, b = high(left_fold, left_percentile), high(right_fold, right_percentile)
    return first_match([(a & b, "high"), (a | b | (middle(left_fold) & middle(right_fold)), "medium")], "low")


def architecture(tier: Column, modifiers: Column, enriched_targets: Column, reversed_targets: Column, assembly_risk: Column) -> Column:
    """Class letter and name."""
    m = lambda name: F.array_contains(modifiers, name)
    return pick(
        [
            (assembly_risk, "F", "ambiguous_assembly_risk"),
            (m("conserved_boundary") & (reversed_targets >= 2), "G", "ancient_conserved_inversion_candidate"),
            (m("terminal_context"), "D", "terminal_translocation_boundary"),
            (m("chromosome_context_change"), "C", "fusion_fission_associated"),
            ((tier == "high") & (enriched_targets >= 1), "E", "recurrent_rearrangement_hotspot"),
        ],
        ("arch_class", "arch_name"),
        ("A", "simple_population_inversion"),
    )


def age_tag(arch: Column, tier: Column, modifiers: Column) -> Column:
    hot = (arch == "E") & (tier == "high")
    return first_match([(arch == "G", "OLD_POLY"), (hot & (F.size(modifiers) >= 2), "MULTI_AGE_HOTSPOT"), (hot, "OLD_BP_YOUNG_INV"), (arch.isin("C", "D"), "LINEAGE_KARYO"), (arch == "B", "ANCIENT_BOUNDARY")], "YOUNG_POP")


def prediction_label(arch: Column) -> Column:
    return first_match([(arch == "E", "predicted_polymorphic_hotspot"), (arch == "G", "candidate_ancient_polymorphism"), (arch == "B", "ancient_boundary_no_polymorphism_evidence"), (arch == "F", "interpret_with_caution_assembly_risk")], "confirmed_polymorphic_in_gar")


def fragility_confidence(tier: Column, supporting: Column) -> Column:
    return first_match([((tier == "high") & (supporting >= 2), "high"), ((tier == "high") | (supporting >= 1), "medium")], "low")


# Verdicts and the structural label.


def existence(layer_a: Column, layer_b: Column, layer_c: Column, quality_c: Column, fisher_p: Column, fisher_or: Column, verdict: Column) -> Column:
    """Verdict and number of the four layers that hold."""
    one = lambda c: holds(c).cast("int")
    n = one(layer_a) + one(layer_b) + one(layer_c & F.upper(quality_c).isin("HIGH", "MODERATE")) + one((fisher_p < 0.05) & (fisher_or > 5))
    label = first_match([(has(verdict, "artifact", "family_structure"), "artifact"), (n >= 3, "confirmed"), (n == 2, "likely"), (n == 1, "candidate")], "insufficient")
    return F.struct(label.alias("verdict"), n.alias("layers"))


def family_verdict(linkage: Column, likeness: Column, jackknife: Column) -> Column:
    link, jk = F.lower(linkage), F.lower(jackknife)
    return first_match([(link == "pca_family_confounded", "family_confounded_fake"), ((link == "single_family") | (jk == "single_family_fragile"), "single_family_real"), (link == "multi_family", "clean"), (likeness > 0.5, "family_confounded_fake")], "ambiguous")


def substrate_verdict(has_sd: Column, identity: Column, length: Column, te: Column, tr: Column) -> Column:
    sd = holds(has_sd)
    return first_match([(sd & (identity > 90) & (length > 1000), "inverted_SD_strong"), (sd & (identity > 85) & (length > 500), "inverted_SD_weak"), (F.upper(te) == "ENRICHED", "TE_flanked"), (F.upper(tr) == "ENRICHED", "TR_rich"), (~has_sd, "none")], "unknown")


def mechanism(substrate: Column, junction: Column, assembled: Column) -> Column:
    """Mechanism and its suffix, null where the substrate is unknown."""
    seen = holds(assembled)
    by, guess = "_supported_by_assembly", "_hypothesis"
    inverted = substrate.startswith("inverted_SD")
    return pick(
        [
            (inverted & seen & (junction == "MH_long"), "NAHR_like", by),
            (inverted, "NAHR_like", guess),
            ((substrate == "none") & seen & (junction == "blunt"), "NHEJ_like", by),
            ((substrate == "none") & seen & (junction == "MH_short"), "MMEJ_like", by),
            (substrate == "none", "NHEJ_like", guess),
            (substrate == "TE_flanked", "TE_mediated_like", guess),
            (substrate == "TR_rich", "MMBIR_like", guess),
        ],
        ("mechanism", "suffix"),
        (F.lit(None).cast("string"), F.lit(None).cast("string")),
    )


OUT_OF_SCOPE = "complex_rearrangement_out_of_scope"


def interior_class(recombinant: Column, n_carriers: Column, left_p: Column, right_p: Column) -> Column:
    return first_match([(n_carriers.isNull() | (n_carriers < 10), "degenerate"), (recombinant > 0.70, OUT_OF_SCOPE), (recombinant > 0.40, "deep_interior_recombinants"), (holds(left_p < 0.01) | holds(right_p < 0.01), "bimodal_boundary_signal"), (recombinant >= 0.05, "edge_recombinants_only")], "clean_simple")


def structural_label(interior: Column, verdict: Column, exists: Column, family: Column, composite: Column, layer_a: Column, layer_b: Column, frequency: Column, conservation: Column, n_children: Column, substrate: Column, mech: Column) -> Column:
    """The label: gates that end the matter first, then what is supported, with the interior's suffix."""
    suffix = first_match([(interior == "deep_interior_recombinants", "_with_deep_recombinants"), (interior == "bimodal_boundary_signal", "_with_partial_interior_recombination")], "")
    supported = exists.isin("confirmed", "likely")
    with_suffix = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts], suffix)
    base = "supported_balanced_inversion_"
    rules = [
        (interior == OUT_OF_SCOPE, F.lit(OUT_OF_SCOPE)),
        (has(verdict, "contradict", "inconsistent"), F.lit("contradicted_candidate")),
        ((exists == "artifact") | (family == "family_confounded_fake"), F.lit("family_confounded_locus")),
        ((family == "single_family_real") & supported, F.lit("single_family_polymorphism")),
        (F.lower(composite) == "likely_composite", F.lit("complex_unresolved_locus")),
        (exists == "insufficient", F.lit("candidate_weak_evidence")),
        (~holds(layer_a) & holds(layer_b) & (frequency > 0.85), F.lit("supported_fixed_inversion_SV_only")),
        (conservation.isin("shared_ancestral", "ASEAN_diagnostic") & supported, with_suffix("supported_shared_between_species_inversion")),
        ((n_children == 1) & supported, F.lit("supported_nested_inversion")),
        (supported & mech.mechanism.isNotNull(), with_suffix(base, mech.mechanism, mech.suffix)),
        (supported & ~substrate.isin("unknown", "none"), with_suffix(base, "with_substrate_mechanism_unresolved")),
        (supported, with_suffix(base, "simple")),
        (exists == "candidate", F.lit("candidate_weak_evidence")),
    ]
    out = F
    for condition, label in rules:
        out = out.when(holds(condition), label)
    return out.otherwise("supported_locus_unreconstructed")


def conservation_class(n_overlaps: Column, n_pairs: Column, flanks: Column, direction: Column, confidence: Column) -> Column:
    none, coherent = n_overlaps == 0, flanks == "both_coherent"
    return first_match(
        [
            (none & (flanks == "untested") & (F.coalesce(direction, F.lit("")) == ""), "untested"),
            (none & flanks.isin("both_coherent", "left_only", "right_only"), "species_specific_polymorphism"),
            (~none & coherent & (n_pairs >= 2), "shared_ancestral"),
            (~none & coherent & direction.isin("inverted", "reference") & (confidence == "high"), "ASEAN_diagnostic"),
            (~none & coherent, "species_specific_rearranged"),
            (~none & flanks.isin("left_only", "right_only", "neither"), "unclassified_complex"),
        ],
        "untested",
    )


# Concordance, confidence and call of one side's two substrate findings; null stands for a missing one.
CONCORDANCE = [
    ("NAHR_CANDIDATE", "strong weak", "agree_nahr high NAHR"),
    ("NAHR_CANDIDATE", "subthreshold", "minimap2_stronger_nahr medium NAHR"),
    ("NAHR_CANDIDATE", "direct_only none", "disagree_biser2_missing high NAHR"),
    ("NAHR_POSSIBLE", "strong weak", "agree_nahr_weak medium NAHR"),
    ("NAHR_POSSIBLE", "subthreshold", "agree_nahr_weak low NAHR"),
    ("NAHR_POSSIBLE", "direct_only none", "minimap2_only_weak low NAHR"),
    ("NHEJ_CANDIDATE", "direct_only none", "agree_nhej high NHEJ"),
    ("NHEJ_CANDIDATE", "subthreshold", "agree_nhej medium NHEJ"),
    ("NHEJ_CANDIDATE", "strong weak", "disagree_minimap2_missing medium UNCERTAIN"),
]


def substrate_concordance(first: Column, second: Column) -> Column:
    """What two substrate findings of one side say together."""
    no_first, no_second = F.coalesce(first, F.lit("")) == "", F.coalesce(second, F.lit("")) == ""
    nahr = second.isin("strong", "weak")
    return pick(
        [
            (no_first & no_second, "no_data", "low", "UNCERTAIN"),
            (no_first & nahr, "biser2_only_nahr", "medium", "NAHR"),
            (no_first, "biser2_only_nhej", "medium", "NHEJ"),
            (first == "COMPLEX_ARCHITECTURE", "complex_flagged", "low", "COMPLEX"),
            (no_second & first.isin("NAHR_CANDIDATE", "NAHR_POSSIBLE"), "minimap2_only_nahr", "medium", "NAHR"),
            (no_second, "minimap2_only_nhej", "medium", "NHEJ"),
            *[((first == a) & second.isin(*b.split()), *values.split()) for a, b, values in CONCORDANCE],
        ],
        ("concordance", "confidence", "call"),
        ("no_data", "low", "UNCERTAIN"),
    )


def worse_side(left: Column, right: Column) -> Column:
    """Of two confidences the lower one."""
    rank = lambda c: first_match([(c == "high", "2"), (c == "medium", "1")], "0").cast("int")
    return F.when(rank(left) <= rank(right), left).otherwise(right)


# Validation.

LEVELS = ["NONE", "UNCERTAIN", "SUPPORTED", "VALIDATED"]


def _rank(level: Column) -> Column:
    return first_match([(level == "SUSPECT", "-1"), *[(level == name, str(i)) for i, name in enumerate(LEVELS)]]).cast("int")


def _level(rank: Column) -> Column:
    return F.when(rank < 0, "SUSPECT").otherwise(F.element_at(F.array(*map(F.lit, LEVELS)), F.greatest(rank, F.lit(0)) + 1))


def validation_level(current: Column, concordance: Column, jackknife: Column, max_delta: Column, fisher_p: Column, fisher_or: Column) -> Column:
    """A fragile jackknife makes the group suspect; otherwise the highest of the present and the earned levels."""
    earned = F.greatest(
        _rank(F.when(F.coalesce(current, F.lit("")) == "", "UNCERTAIN").otherwise(current)),
        F.when(holds((fisher_p < 0.05) & (fisher_or > 5)), 3).otherwise(-2),
        F.when(holds((concordance >= 0.70) & (jackknife == "robust")), 2).otherwise(-2),
    )
    return F.when(holds(jackknife == "fragile") | holds(max_delta > 0.3), "SUSPECT").otherwise(_level(earned))


# What a jackknife verdict says of family linkage, its quality flag, and whether it caps the level.
JACKKNIFE = {
    "robust_multi_family": ("multi_family", None, False),
    "multi_family_contributing": ("multi_family", "partial_robustness", False),
    "few_family": ("few_family", "restricted_family_spread", True),
    "single_family_fragile": ("single_family", "family_specific_polymorphism", True),
    "fragile": ("pca_family_confounded", "pca_groups_family_confounded", False),
    "pca_family_driven": ("pca_family_confounded", "pca_groups_family_confounded", False),
}


def capped_validation(current: Column, concordance: Column, jackknife: Column, max_delta: Column, fisher_p: Column, fisher_or: Column, cap: Column) -> Column:
    """Level, quality flags and family linkage, where a jackknife verdict or an outer cap limits promotion."""
    jk = F.lower(F.coalesce(jackknife, F.lit("")))
    bare = holds((jk == "") & (max_delta > 0.3))
    linkage = first_match([(jk == name, link) for name, (link, _, _) in JACKKNIFE.items()] + [(bare, "uncertain")], "unknown")
    flags = first_match([(jk == name, flag) for name, (_, flag, _) in JACKKNIFE.items() if flag] + [(bare, "high_jackknife_delta_no_verdict")], "normal")
    suspect = jk.isin(*[name for name, (link, _, _) in JACKKNIFE.items() if link == "pca_family_confounded"])
    earned = F.greatest(
        _rank(F.when(F.coalesce(current, F.lit("")) == "", "UNCERTAIN").otherwise(current)),
        F.when(holds((fisher_p < 0.05) & (fisher_or > 5)), 3).otherwise(-2),
        F.when(holds((concordance >= 0.70) & jk.isin("robust_multi_family", "single_family_fragile", "few_family")), 2).otherwise(-2),
    )
    inner = F.when(jk.isin(*[name for name, (_, _, capped) in JACKKNIFE.items() if capped]) | bare, 2).otherwise(3)
    level = _level(F.least(earned, F.coalesce(_rank(cap), F.lit(3)), inner))
    return F.struct(F.when(suspect, "SUSPECT").otherwise(level).alias("level"), flags.alias("flags"), linkage.alias("linkage"))


SHELF = {"snp": 0.50, "uncertain": 2.00, "coverage": 0.60, "coverage_cv": 0.70, "fst": 2.00, "het": 1.30}


def shelf_flag(snp: Column, uncertain: Column, coverage: Column, coverage_cv: Column, fst: Column, het: Column, bounds: dict[str, float] = SHELF) -> Column:
    """Any two artefacts are messy; one is named; without one, a biological signal is clean."""
    low_snp, unsure, thin = holds(snp <= bounds["snp"]), holds(uncertain >= bounds["uncertain"]), holds((coverage <= bounds["coverage"]) & (coverage_cv <= bounds["coverage_cv"]))
    n = low_snp.cast("int") + unsure.cast("int") + thin.cast("int")
    return first_match([(n >= 2, "messy"), (thin, "coverage_artifact"), (unsure, "high_uncertain"), (low_snp, "low_snp"), (holds(fst >= bounds["fst"]) | holds(het >= bounds["het"]), "clean")], "unknown")


# Least windows, age and score bounds of the shape classes.
SHAPE = {"u": 1.5, "inside": 1.5, "peak": 1.5, "asymmetry": 1.0, "oldness": 1.2, "dxy": 1e-4, "windows": 8, "flat": 0.35}


def shape_class(n_windows: Column, ratio: Column, oldness: Column, dxy_inside: Column, asymmetry: Column, peak_dxy: Column, peak_fst: Column, u_score: Column, breakpoint: Column, flatness: Column, bounds: dict[str, float] = SHAPE) -> Column:
    """Primary and secondary class: too little data, too young, else the shapes that hold, in order; three or more are mixed."""
    b = bounds
    signals = {
        "asymmetric_edge": asymmetry >= b["asymmetry"],
        "locally_adapted_internal_peak_like": holds(peak_dxy >= b["peak"]) | holds(peak_fst >= b["peak"]),
        "neutral_like_U_shape": (u_score >= b["u"]) & (peak_dxy < b["peak"]),
        "locally_adapted_breakpoint_like": (breakpoint >= b["inside"]) & ~holds(u_score >= b["u"]),
        "flat_high_deep_structural_haplotype": (ratio >= b["inside"]) & (flatness <= b["flat"]),
    }
    hits = F.array_compact(F.array(*[F.when(holds(c), F.lit(n)) for n, c in signals.items()]))
    none = F.lit(None).cast("string")
    return pick(
        [
            (ratio.isNull() | (n_windows < b["windows"]), "insufficient_data", none),
            (oldness.isNull() | (oldness < b["oldness"]) | (dxy_inside < b["dxy"]), "young_weak_divergence", none),
            (F.size(hits) == 0, "complex_mixed", none),
            (F.size(hits) >= 3, "complex_mixed", F.try_element_at(hits, F.lit(2))),
        ],
        ("primary", "secondary"),
        (F.try_element_at(hits, F.lit(1)), F.try_element_at(hits, F.lit(2))),
    )


def composite_flag(n: Column, two_block: Column, multi_block: Column, gradient: Column, homogeneous: Column) -> Column:
    """From the shares of samples whose structure is of each kind."""
    return first_match([(n == 0, "unknown_no_data"), ((two_block > 0.20) | (multi_block > 0.20), "likely_composite"), ((two_block >= 0.05) | (multi_block >= 0.05) | (gradient >= 0.20), "maybe_composite"), (homogeneous >= 0.80, "clean")], "maybe_composite")


def quality_flags(composite: Column, silhouette: Column, bic_gap: Column, phase: Column) -> Column:
    """Level, flags and promotion cap after group building."""
    capped = holds(composite == "likely_composite")
    flags = {"composite_cap": capped, "maybe_composite_flagged": composite == "maybe_composite", "low_silhouette": silhouette < 0.25, "weak_k3_fit": bic_gap < 0.05, "low_phase": phase < 0.30}
    return F.struct(F.lit("UNCERTAIN").alias("level"), notes(flags, "normal", ",").alias("flags"), F.when(capped, F.lit("UNCERTAIN")).alias("promotion_cap"))


# Breakends and filters.


def breakend_orientation(alt: Column) -> Column:
    """Strand pairing by the brackets' side: ]p]t, [p[t, t[p[, t]p]; null for other alleles."""
    return first_match([(alt.startswith("]") & alt.endswith("]"), "3to3"), (alt.startswith("[") & alt.endswith("["), "5to3"), (F.instr(alt, "[") > 1, "5to5"), (F.instr(alt, "]") > 1, "3to5")])


def breakend_orientation_by_index(alt: Column) -> Column:
    """By where the first bracket stands: at the front 3to3 or 5to3; at both ends of the mate 3to5 or 5to5."""
    close, open_ = F.instr(alt, "]"), F.instr(alt, "[")
    plain = ~F.substring(alt, 1, 1).isin("[", "]")
    return first_match([((close > 1) & alt.endswith("]") & plain, "3to5"), (close > 0, "3to3"), ((open_ > 1) & alt.endswith("["), "5to5"), (open_ > 0, "5to3")], "unknown")


def read_evidence(gt: Column, n_alt: Column) -> Column:
    pair = F.array_sort(F.split(gt, "[/|]"))
    zero, one = F.lit("0"), F.lit("1")
    return first_match([((pair == F.array(zero, one)) | (pair == F.array(one, one)), "strong"), ((pair == F.array(zero, zero)) & (n_alt >= 1), "weak"), (pair == F.array(zero, zero), "absent")], "missing")


def gap_flag(frac_n: Column, frac_masked: Column, coverage: Column, n_low: Column) -> Column:
    return first_match([(frac_n > 0.5, "ASSEMBLY_GAP"), (frac_masked > 0.5, "REPEAT_RICH"), (coverage.isNotNull() & (n_low > 50), "LOW_MAPPABILITY")], "DROPOUT")


def is_polymorphic(calls: Column) -> Column:
    """Whether any call of the array has an allele other than the reference."""
    return F.coalesce(F.exists(calls, lambda c: F.coalesce(c, F.lit("")).rlike("[1-9]")), F.lit(False))


def strict_filter(sv_type: Column, wanted: str, filter_column: Column, expression: str | None = None, need_pass: bool = True) -> Column:
    """Records of a type that pass and satisfy an SQL expression over the record's columns."""
    out = sv_type == wanted
    if need_pass:
        out = out & (filter_column == "PASS")
    return holds(out & F.expr(expression)) if expression else holds(out)


def interval_resolution(n_windows: Column, least: int = 10) -> Column:
    """Whether enough windows overlap an interval; null stands for no annotation."""
    return first_match([(n_windows.isNull(), "no_annot"), (n_windows >= least, "sufficient")], "insufficient")


def interval_call(inverted_windows: Column, other_windows: Column, least: int = 3) -> Column:
    """A sample's call from the windows of its runs of either kind."""
    a, b = holds(inverted_windows >= least), holds(other_windows >= least)
    return first_match([(a & b, "SPLIT"), (a, "INV_INV"), (b, "INV_nonINV")], "UNINFORMATIVE")


def gap_category(elevation: Column, far: Column, background: Column, mad: Column) -> Column:
    """What lies between two blocks, by its median similarity over the background's and that of far windows."""
    return first_match([(elevation < mad, "clean_background"), (far > background + mad, "family_ld_band"), (elevation > 3 * mad, "extended_suppression")], "transition_zone")
