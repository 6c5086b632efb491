"""Classifiers and small scalar helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The trait names, in their usual order.
TRAITS = [
    "ala", "arg", "asp", "gln", "glu", "gly", "his", "ile", "leu", "lys", "met", "phe", "pro", "ser", "thr", "trp",
    "tyr", "val", "total", "ShikFam", "AspFam", "AspFam_Asp", "SerFam", "GluFam", "GluFam_glu", "BCAA", "PyrFam",
    "ala_t", "arg_t", "asp_t", "gln_t", "glu_t", "gly_t", "his_t", "ile_t", "leu_t", "lys_t", "met_t", "phe_t",
    "pro_t", "ser_t", "trp_t", "tyr_t", "val_t", "ile_BCAA", "leu_BCAA", "val_BCAA", "arg_GluFam", "gln_GluFam",
    "glu_GluFam", "his_GluFam", "pro_GluFam", "phe_ShikFam", "trp_ShikFam", "tyr_ShikFam", "gly_SerFam",
    "ser_SerFam", "ala_PyrFam", "leu_PyrFam", "val_PyrFam", "asp_AspFam", "ile_AspFam", "lys_AspFam", "met_AspFam",
    "thr_AspFam",
]

# Pathway names and category-code patterns; "0" marks a curated SNP list.
PATHWAYS = {
    "protein_aa_activation": "29.1",
    "protein_synthesis": "29.2",
    "protein_targeting": "29.3",
    "protein_postrans": "29.4",
    "protein_degradation": "(?!29.5.11)29.5",
    "degradation_subtilases": "29.5.1$",
    "degradation_autophagy": "29.5.2$",
    "cys_protease": "29.5.3$",
    "asp_protease": "29.5.4$",
    "ser_protease": "29.5.5$",
    "metallo_protease": "29.5.7$",
    "degradation_AAA": "29.5.9$",
    "degradation_ubiquitin": "29.5.11",
    "protein_folding": "29.6",
    "protein_glyco": "29.7",
    "protein_assembly": "29.8",
    "aa_transport": "34.3$",
    "tca_cycle": "8",
    "e_alt_oxidase": "9.4",
    "isoprenoids": "16.1",
    "phenylpropanoids": "16.2",
    "N_containing": "16.4",
    "S_containing": "16.5",
    "flavonoids": "16.8",
    "aa_synthesis": "13.1",
    "aa_degradation": "13.2",
    "glycolysis": "4",
    "glycolysis_cystolic": "4.1",
    "glycolysis_plastid": "4.2",
    "glycolysis_other": "4.3",
    "aa_syn_nobcat_haplo": "0",
    "aa_deg_bcat_haplo": "0",
}

# Labels that replace others before the exclusion list applies.
PATHWAY_RENAMES = {
    "aa_degradation": "aa_deg_old",
    "aa_synthesis": "aa_syn_old",
    "aa_deg_bcat_haplo": "aa_degradation",
    "aa_syn_nobcat_haplo": "aa_synthesis",
}

# Pathways left out of the reports.
PATHWAY_EXCLUDE = [
    "aa_deg_bcat", "aa_syn_nobcat", "aa_deg_old", "aa_syn_old", "asp_protease", "cys_protease", "degradation_AAA",
    "degradation_autophagy", "degradation_subtilases", "glycolysis_cystolic", "glycolysis_plastid",
    "glycolysis_other", "metallo_protease", "protein_degradation_old", "ser_protease",
]

# Order of the category labels in reports.
FAMILY_ORDER = ["aspartate", "BCAA_pyruvate", "glutamate", "serine", "aromatic", "total"]
MEASURE_ORDER = ["absolute", "relative", "family"]
CATEGORY_ORDER = ["amino acid", "primary", "specialized", "protein"]


# What in a trait's name tells its family, and in a pathway's name its category; the first that fits counts.
FAMILY_PATTERNS = {"glutamate": "arg|glu|gln|pro|his|GluFam", "serine": "gly|ser|SerFam", "aromatic": "phe|tyr|trp|ShikFam", "total": "total"}
ASPARTATE, NOT_ASPARTATE = "asp|thr|met|AspFam", "ile"
CATEGORY_PATTERNS = {"protein": "degradation_|protein_|protease", "specialized": "flavonoids|isoprenoids|N_containing|phenylpropanoids|S_containing"}
AMINO_ACID = "aa_degradation|aa_synthesis|aa_transport"


def trait_family(trait: Column) -> Column:
    family = F.when(trait.rlike(ASPARTATE) & ~trait.rlike(NOT_ASPARTATE), "aspartate")
    for name, pattern in FAMILY_PATTERNS.items():
        family = family.when(trait.rlike(pattern), name)
    return family.when(trait.isNotNull(), "BCAA_pyruvate")


def trait_measure(trait: Column) -> Column:
    return (
        F.when(~trait.contains("_"), "absolute")
        .when(trait.contains("_t"), "relative")
        .when(trait.isNotNull(), "family")
    )


def pathway_category(pathway: Column, fallback: str = "primary", amino: str = AMINO_ACID) -> Column:
    return (
        F.when(pathway.rlike(CATEGORY_PATTERNS["protein"]), "protein")
        .when(pathway.rlike(CATEGORY_PATTERNS["specialized"]), "specialized")
        .when(pathway.rlike(amino), "amino acid")
        .when(pathway.isNotNull(), fallback)
    )


def label_rank(col: Column, order: list[str]) -> Column:
    """Position of a label in a fixed order (1-based); unknown labels sort last."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), col).cast("int")
    return F.when(rank > 0, rank).otherwise(F.lit(len(order) + 1))


def clamp(col: Column) -> Column:
    """Into [0, 1]; NULL stays NULL."""
    return F.when(col.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), col)))


def significant_digits(col: Column, digits: int = 4) -> Column:
    scale = F.pow(F.lit(10.0), F.lit(digits - 1.0) - F.floor(F.log10(F.abs(col))).cast("double"))
    return F.when(col == 0, F.lit(0.0)).otherwise(F.bround(col * scale, 0) / scale)


def size_bin(size: Column, width: int = 10000, top: int = 50000) -> Column:
    """Label of the right-closed bin of `size`; the first bin is closed on both sides."""
    edge = F.greatest(F.ceil(size / F.lit(float(width))), F.lit(1)) * width
    upper = edge.cast("bigint").cast("string")
    lower = (edge - width).cast("bigint").cast("string")
    label = F.concat(F.when(edge <= width, "[").otherwise("("), lower, F.lit(","), upper, F.lit("]"))
    return F.when((size >= 0) & (size <= top), label)
