"""Domain entities: seed vocabulary and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns define what counts as an entity.
SOLID_ELECTROLYTE = r"Na[1-9]?\+?[x-z]?Zr\d?Si[0-9x-z]?P[0-9x-z]?O\d{1,2}"
SODIUM_SALT = r"Na(?:PF6|BF4|ClO4|FSI|TFSI|DFOB|BOB|FP|OTf|Tf|N\(SO2F\)2|N\(CF3SO2\)2)"
LAYERED_OXIDE = r"(?:P2|P3|O3|O2)-type\s*Na[x0-9\.]*[A-Z][a-z]?\d?O\d"
FORMULA = r"\b(?:Na|Li|K|Mg|Ca|Al|Zr|Ti|Mn|Co|Ni|Fe|Cr|V|P|S|O|Cl|F|N|C)(?:[a-z])?(?:\d+\.?\d*)?(?:[A-Z][a-z]?(?:\d+\.?\d*)?){1,8}\b"
MEASURE = r"\d+\.?\d*\s*(?:mS/cm|S/cm|mAh/g|Wh/kg|V\s*vs\.?\s*Na\+?/?Na|μS/cm|eV|GPa|MPa|kPa|mA/cm[²2]|μA/cm[²2]|mol/L|M\b|wt\.?%|vol\.?%)"
PATTERNS = (SOLID_ELECTROLYTE, SODIUM_SALT, LAYERED_OXIDE, FORMULA, MEASURE)

# The seed vocabulary of sodium-ion electrolyte research.
SEEDS = (
    "NASICON", "Na3Zr2Si2PO12", "Na1+xZr2SixP3-xO12", "Na3.4Sc0.4Zr1.6Si2PO12", "NZSP",
    "β-Al2O3", 'β"-Al2O3', "sodium beta-alumina", "Na-β-alumina",
    "Na3PS4", "Na3SbS4", "Na3BS3", "Na2.9PS3.95Se0.05", "Na3PSe4",
    "NaPF6", "NaClO4", "NaFSI", "NaTFSI", "NaBF4", "NaDFOB", "NaOTf",
    "EC", "PC", "DME", "TEGDME", "diglyme", "FEC",
    "ionic conductivity", "transference number", "electrochemical stability window", "ESW", "SEI", "CEI",
    "Nyquist", "EIS", "CV", "LSV", "GITT", "rate capability", "Coulombic efficiency",
    "NaCoO2", "NaMnO2", "NaFeO2", "Na2/3MnO2", "HC", "hard carbon",
)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeds_in(c: Column | str, seeds: tuple[str, ...] = SEEDS) -> Column:
    """Seeds that the text contains, spelt as in the vocabulary; case counts for seeds with a capital first letter only."""
    if not seeds:
        return F.array().cast("array<string>")

    # both spellings of the text are made once; a seed in lower case is in the lower-cased text wherever it is in the text
    def found(t: Column) -> Column:
        return F.array_compact(F.array(*(F.when(t["as_is"].contains(s) if s[0].isupper() else t["low"].contains(s.lower()), F.lit(s)) for s in seeds)))

    texts = F.struct(_c(c).alias("as_is"), F.lower(_c(c)).alias("low"))
    return F.element_at(F.transform(F.array(texts), found), 1)


def pattern_hits(c: Column | str, pattern: str) -> Column:
    """All matches of one pattern, trimmed."""
    return F.transform(F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(0)), lambda x: F.trim(x))


def drop_noise(c: Column | str) -> Column:
    """Without single characters and plain numbers."""
    return F.filter(_c(c), lambda x: (F.length(x) > 1) & ~x.rlike(r"^\d+\.?\d*$"))


def entities(c: Column | str, seeds: tuple[str, ...] = SEEDS) -> Column:
    """Distinct seeds and pattern hits without noise, in code-point order; empty for null."""
    c = F.coalesce(_c(c), F.lit(""))
    return F.array_sort(drop_noise(F.array_distinct(F.concat(seeds_in(c, seeds), *(pattern_hits(c, p) for p in PATTERNS)))))
