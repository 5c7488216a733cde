"""Scalars over sequences, names, calls and records: all built-in expressions.

Null arguments give null unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.rules import first_match
from ..operators.variant_rules import has


def event_signature(chrom: Column, pos: Column, kind: Column, length: Column, ref: Column, alt: Column, left: Column, right: Column) -> Column:
    """chrom:pos:type:length:ref>alt:last five of the left flank|first five of the right; null flanks are empty, a null length 0."""
    l5, r5 = F.coalesce(F.right(left, F.lit(5)), F.lit("")), F.coalesce(F.left(right, F.lit(5)), F.lit(""))
    return F.concat_ws(":", chrom, pos, kind, F.coalesce(length, F.lit(0)).cast("int"), F.concat(ref, F.lit(">"), alt), F.concat(l5, F.lit("|"), r5))


def indel_motif(kind: Column, ref: Column, alt: Column) -> Column:
    """The longer allele from the last shared base on; empty for other types."""
    shared = F.greatest(F.least(F.length(ref), F.length(alt)), F.lit(1))
    return F.when(kind == "INS", F.substr(alt, shared)).when(kind == "DEL", F.substr(ref, shared)).otherwise("")


def flank(sequence: Column, start: Column, end: Column) -> Column:
    """Upper-cased 0-based half-open slice, held to the sequence's ends."""
    a = F.least(F.greatest(start, F.lit(0)), F.length(sequence))
    b = F.least(F.greatest(end, a), F.length(sequence))
    return F.upper(F.substr(sequence, a + 1, b - a))


# Defaults of this library, not taken from elsewhere: patterns of chromosome names and what they become; other names stay.
CHROMOSOMES = [(r"^(?:chr|lg|scaffold_?)0*(\d+)$", "LG$1"), (r"^0*(\d+)$", "LG$1"), (r"^(?:chr)?(x|y|z|w|mt)$", "$1")]


def chromosome(name: Column, patterns: list[tuple[str, str]] = CHROMOSOMES) -> Column:
    out = F
    for pattern, form in patterns:
        out = out.when(name.rlike("(?i)" + pattern), F.upper(F.regexp_replace(name, "(?i)" + pattern, form)))
    return out.otherwise(name)


# Defaults of this library, not taken from elsewhere: words in a class or family, in this order, and their buckets.
REPEAT_BUCKETS = [("ltr", "LTR"), ("line", "LINE"), ("sine", "SINE"), ("helitron", "Helitron"), ("mite", "MITE"), ("dna", "DNA"), ("tir", "DNA"), ("satellite", "Satellite"), ("simple", "Simple"), ("low_complexity", "Simple")]
NON_CODING = [("trna", "tRNA"), ("rrna", "rRNA"), ("mirna", "miRNA"), ("snorna", "snoRNA"), ("snrna", "snRNA"), ("lnc", "lncRNA")]


def by_word(text: Column, words: list[tuple[str, str]], otherwise: str) -> Column:
    return first_match([(has(text, w), label) for w, label in words], otherwise)


def repeat_bucket(kind: Column, words: list[tuple[str, str]] = REPEAT_BUCKETS) -> Column:
    return by_word(kind, words, "Other")


def non_coding_class(feature: Column, product: Column, words: list[tuple[str, str]] = NON_CODING) -> Column:
    return by_word(F.concat_ws(" ", feature, product), words, "other_ncRNA")


def attribute(text: Column, key: str) -> Column:
    """Value of a key in `key=value;...`."""
    return F.try_element_at(F.str_to_map(text, F.lit(";"), F.lit("=")), F.lit(key))


def info_map(text: Column) -> Column:
    """Record information by name; flags have the value `true`."""
    return F.transform_values(F.str_to_map(F.when(text != ".", text), F.lit(";"), F.lit("=")), lambda k, v: F.coalesce(v, F.lit("true")))


def sample_map(names: Column, values: Column) -> Column:
    """The fields of one sample by name; trailing names without values are left out."""
    n, v = F.split(names, ":"), F.split(values, ":")
    k = F.least(F.size(n), F.size(v))
    return F.map_from_arrays(F.slice(n, F.lit(1), k), F.slice(v, F.lit(1), k))


def read_support(sample: Column) -> Column:
    """Alternative and reference reads of a sample's fields: DV/DR, RV/RR, and the pairs PR and SR."""

    def pair(a: Column, b: Column):
        a, b = a.try_cast("int"), b.try_cast("int")
        both = a.isNotNull() & b.isNotNull()
        return F.when(both, a).otherwise(0), F.when(both, b).otherwise(0)

    at = lambda name: F.try_element_at(sample, F.lit(name))
    halves = [pair(at("DV"), at("DR")), pair(at("RV"), at("RR"))]
    for name in ("PR", "SR"):
        parts = F.split(at(name), ",")
        halves.append(pair(F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(1))))
    total = lambda i: sum((h[i] for h in halves[1:]), halves[0][i])
    return F.struct(total(0).alias("n_alt"), total(1).alias("n_ref"))


def group_name(name: Column) -> Column:
    """inv_<candidate>_<karyotype>[__<suffix>] as karyotype, dimension and parent group."""
    body, suffix = F.regexp_extract(name, r"^inv_(.+?)_([^_]+)(?:__(.*))?$", 2), F.regexp_extract(name, r"__(.*)$", 1)
    dimension = first_match([(suffix == "", "karyotype"), (suffix.rlike("^sub[0-9]+$"), "karyotype_subcluster"), (suffix == "noise", "karyotype_subcluster_noise"), (suffix.startswith("ancestry"), "ancestry"), (suffix.startswith("ghsl_"), "ghsl"), (suffix.startswith("family_"), "family")], ".")
    return F.struct(body.alias("karyotype"), dimension.alias("dimension"), F.when(suffix != "", F.regexp_replace(name, "__.*$", "")).alias("parent"))


def bin_label(bp: Column) -> Column:
    mega = F.concat(F.floor(bp / 1_000_000).cast("string"), F.lit("Mb"))
    return F.when(bp < 1_000_000, F.concat(F.floor(bp / 1000).cast("string"), F.lit("kb"))).otherwise(mega)


def or_else(value: Column, fallback: Column | str) -> Column:
    """The fallback for null, empty and NA text."""
    text = value.cast("string")
    return F.when(text.isNull() | text.isin("", "NA"), fallback if isinstance(fallback, Column) else F.lit(fallback)).otherwise(text)


def residual_dosage(observed: Column, shares: Column, frequencies: Column) -> Column:
    """Observed copies less twice the sum of ancestry share times frequency."""
    return observed - 2 * F.aggregate(F.zip_with(shares, frequencies, lambda q, f: q * f), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def certain_call(posteriors: Column, least: float = 0.9) -> Column:
    """Largest of the posteriors, and whether it is under the bound."""
    top = F.array_max(posteriors)
    return F.struct(top.alias("largest"), (top < least).alias("uncertain"))


def ancestry_label(shares: Column) -> Column:
    """Q and the 1-based place of the first largest share."""
    return F.when(F.size(shares) > 0, F.concat(F.lit("Q"), F.array_position(shares, F.array_max(shares)).cast("string")))


def content_digest(data: Column) -> Column:
    return F.sha2(data, 256)


def cache_key(parts: Column, prefix: str) -> Column:
    """Prefix and the first 24 hex digits of the digest of a struct's JSON (name its fields in order)."""
    return F.concat(F.lit(prefix + "."), F.left(F.sha2(F.to_json(parts), 256), F.lit(24)))


def compact_row(values: Column) -> Column:
    """One character a sample, a point for missing."""
    return F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("."))), "")


def cross_outcome(a: Column, b: Column) -> Column:
    """What two parents' arrangements (R, H, I) give; null where one is missing."""
    pair = F.array_join(F.array_sort(F.array(a, b)), "")
    return F.when(a.isNotNull() & b.isNotNull(), first_match([(pair == "RR", "concord_R"), (pair == "II", "concord_I"), (pair == "IR", "complementary"), (pair.isin("HR", "HI"), "het_segregating"), (pair == "HH", "het_x_het")]))


# Diversity and load points of an outcome.
CROSS_POINTS = {"complementary": (2.0, 1.0), "het_x_het": (1.5, 0.5), "het_segregating": (1.0, 0.5), "concord_R": (0.0, 0.0), "concord_I": (0.0, 0.0)}


def cross_points(outcome: Column, which: int) -> Column:
    out = F
    for name, points in CROSS_POINTS.items():
        out = out.when(outcome == name, F.lit(points[which]))
    return out.otherwise(F.lit(None).cast("double"))


def target_site_duplication(left: Column, right: Column, least: int = 5, most: int = 20, within: int = 30) -> Column:
    """Length of the longest end of the left flank that begins within the first bases of the right flank; 0 if none."""
    sizes = F.sequence(F.lit(least), F.lit(most))
    fits = F.filter(sizes, lambda k: _begins_within(left, right, k, within))
    return F.coalesce(F.array_max(fits), F.lit(0))


def _begins_within(left: Column, right: Column, k: Column, within: int) -> Column:
    at = F.position(F.substr(left, F.length(left) - k + 1, k), right)
    return (F.length(left) >= k) & (at >= 1) & (at <= within)


def decode_bytes(text: Column) -> Column:
    """Numbers 0 to 255 of base64 text."""
    digits = F.hex(F.unbase64(text))
    return F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))
