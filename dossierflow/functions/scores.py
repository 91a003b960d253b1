"""Column functions for confidences, levels, identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default confidences of native and recognised text, penalty and floor for recognised text.
NATIVE_DEFAULT, RECOGNISED_DEFAULT, RECOGNISED_PENALTY, RECOGNISED_FLOOR = 0.90, 0.70, 0.05, 0.30


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def block_confidence(raw: Column, recognised: Column) -> Column:
    """Confidence of a block: a default for null, less a penalty for recognised text, within 0 and 1."""
    own = F.coalesce(raw, F.when(recognised, F.lit(RECOGNISED_DEFAULT)).otherwise(F.lit(NATIVE_DEFAULT)))
    return clamp(F.when(recognised, F.greatest(F.lit(RECOGNISED_FLOOR), own - RECOGNISED_PENALTY)).otherwise(own))


def recognition_confidence(percent: Column) -> Column:
    """Percentages of a recogniser as 0 to 1; below 0 is 0."""
    return F.when(percent < 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), percent / 100))


def level(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


def gap_severity(minutes: Column, significant: int = 120) -> Column:
    return F.when(minutes >= significant, "SIGNIFICANT").otherwise("MODERATE")


# Base severity by type of contradiction.
BASE_SEVERITY = {"TIME_CONFLICT": 2, "LOCATION_CONFLICT": 3, "STATEMENT_VS_EVIDENCE": 4, "DENIAL_VS_ASSERTION": 3}
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def severity_rank(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITIES) for x in (s, i + 1)])[severity]


def is_high(severity: Column) -> Column:
    """HIGH or CRITICAL; null is neither."""
    return F.coalesce(severity.isin("HIGH", "CRITICAL"), F.lit(False))


def compare_severity(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null for an unknown severity."""
    return F.signum(severity_rank(a) - severity_rank(b)).cast("int")


def default_confidence(entity_type: Column) -> Column:
    """Confidence of an entity that has none, by its type (fixed values)."""
    return F.when(entity_type.isin("PHONE", "ADDRESS", "TIME"), F.lit(0.90)).when(entity_type.isin("PERSON", "LOCATION", "WEAPON", "EVIDENCE"), F.lit(0.85)).otherwise(F.lit(0.80))


def severity(kind: Column, confidence: Column, n_shared: Column, same_time: Column) -> Column:
    """Base of the type, one more at 0.9, one less below 0.6, one more for two shared entities, one more for places at one time; within LOW and CRITICAL."""
    base = F.coalesce(F.create_map(*[F.lit(x) for pair in BASE_SEVERITY.items() for x in pair])[kind], F.lit(2))
    one = lambda c: F.when(c, 1).otherwise(0)
    score = base + one(confidence >= 0.9) - one(confidence < 0.6) + one(n_shared >= 2) + one(same_time & (kind == "LOCATION_CONFLICT"))
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(F.lit(1), F.least(F.lit(4), score)).cast("int"))


def answer_confidence(n_sources: Column, contradictions: Column, gaps: Column) -> Column:
    base = F.least(F.lit(0.9), 0.5 + n_sources * 0.1) * F.when(contradictions, 0.7).otherwise(1.0) * F.when(gaps, 0.9).otherwise(1.0)
    return F.when(n_sources == 0, F.lit(0.0)).otherwise(F.round(base, 2))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def name_key(name: Column) -> Column:
    """Lower case, stripped, squashed: the form of names in node ids."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+|\s+\z", ""), r"(?U)\s+", " "))


def node_id(node_type: Column, name: Column, case_id: Column) -> Column:
    return F.concat_ws(":", node_type, name_key(name), case_id)


def node_hash(node_type: Column, name: Column, case_id: Column) -> Column:
    return F.substring(F.sha2(node_id(node_type, name, case_id).cast("binary"), 256), 1, 16)


def numbered(prefix: str, case_id: Column, index: Column) -> Column:
    """``PREFIX_case_0001``; longer numbers keep all their digits."""
    return F.format_string(f"{prefix}_%s_%04d", F.translate(case_id, "- ", "__"), index)


def entity_key(*parts: Column) -> Column:
    """Identifier of an entity from what identifies it, equal in every run."""
    return F.concat(F.lit("ENT_"), F.upper(F.substring(F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 8)))
