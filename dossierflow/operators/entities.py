"""Rule-based entities with positions, and their merge with a model's entities."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import role_of
from ..session import ship_package
from .base import once

# Notations of phone numbers and addresses, in the order in which they are tried, with their confidences.
PHONES = (r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}", r"\b\d{10}\b")
ADDRESSES = (
    r"(?i)\b\d{1,5}\s+[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Way|Circle|Cir|Terrace|Ter|Highway|Hwy)\b",
    r"(?i)\bP\.?O\.?\s*Box\s+\d+\b",
)
# Words for weapons and for evidence.
WEAPONS = (
    "gun", "pistol", "revolver", "rifle", "shotgun", "firearm", "knife", "blade", "dagger", "machete", "sword", "bat", "baseball bat", "club", "hammer", "axe", "crowbar",
    "brass knuckles", "taser", "stun gun", "pepper spray", "mace",
)
EVIDENCE = (
    "fingerprint", "fingerprints", "dna", "blood", "hair", "fiber", "fibers", "footprint", "footprints", "shell casing", "shell casings", "bullet", "bullets", "cufflink",
    "cufflinks", "wallet", "id card", "driver's license", "license plate", "surveillance", "cctv", "camera", "photograph", "photographs", "document", "receipt", "phone records",
    "text messages", "email", "emails",
)
CONFIDENCE = {"PHONE": 0.85, "ADDRESS": 0.80, "WEAPON": 0.90, "EVIDENCE": 0.85}
# Labels of common named-entity models.
MODEL_LABELS = {"PERSON": "PERSON", "PER": "PERSON", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "ORG": "LOCATION", "DATE": "TIME", "TIME": "TIME"}

_PHONES = tuple(map(re.compile, PHONES))
_ADDRESSES = tuple(map(re.compile, ADDRESSES))

Span = tuple[str, str, int, int, float]


def _first_wins(text: str, patterns: tuple[re.Pattern[str], ...], kind: str, shortest: int) -> list[Span]:
    taken: list[tuple[int, int]] = []
    out = []
    for pattern in patterns:
        for m in pattern.finditer(text):
            a, b = m.span()
            if all(b <= x or a >= y for x, y in taken) and len(m[0].strip()) >= shortest:
                taken.append((a, b))
                out.append((kind, m[0].strip(), a, b, CONFIDENCE[kind]))
    return out


class Keywords:
    """One pass over a text for all keywords; overlapping ones all count, but only as whole words."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, words in (("WEAPON", WEAPONS), ("EVIDENCE", EVIDENCE)):
            for w in words:
                self.automaton.add_word(w, (kind, len(w)))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[Span]:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out = []
        for last, (kind, n) in self.automaton.iter(low):
            a, b = last + 1 - n, last + 1
            if not (a and low[a - 1].isalnum()) and not (b < len(low) and low[b].isalnum()):
                out.append((kind, text[a:b], a, b, CONFIDENCE[kind]))
        return out


_KEYWORDS: list[Keywords] = []


def find_entities(text: str | None) -> list[Span]:
    """Phones, addresses, weapons and evidence of a text, by position."""
    if not text:
        return []
    if not _KEYWORDS:
        _KEYWORDS.append(Keywords())
    found = _KEYWORDS[0].find(text)
    if any(c.isdigit() for c in text):
        found += _first_wins(text, _PHONES, "PHONE", 7)
    found += _first_wins(text, _ADDRESSES, "ADDRESS", 1)
    return sorted(set(found), key=lambda s: (s[2], s[3], s[0]))


ENTITY = "case_id STRING, document_id STRING, chunk_id STRING, entity_type STRING, text STRING, start_char INT, end_char INT, confidence DOUBLE, source STRING, role STRING"


def _scan(frames: Iterator[pd.DataFrame], find: Callable[[str | None], list[Span]], source: str) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ENTITY.split(", ")]
    for f in frames:
        rows = []
        for case, doc, chunk, text, score, role in zip(*(f[c] for c in ("case_id", "document_id", "chunk_id", "text", "score", "role"))):
            for kind, word, a, b, confidence in find(text):
                rows.append((case, doc, chunk, kind, word, a, b, round(confidence * score, 6), source, role if kind == "PERSON" else None))
        yield pd.DataFrame(rows, columns=names)


def extract(chunks: DataFrame, find: Callable[[str | None], list[Span]] = find_entities, source: str = "rule") -> DataFrame:
    """Entities of every chunk with a deterministic ``entity_id``; their confidence is that of the rule times that of the chunk.

    ``find`` may be any function from a text to (type, text, start, end,
    confidence), such as a trained model. Null and empty texts give none; a
    chunk delivered twice counts once.
    """
    ship_package(chunks.sparkSession)
    own = once(chunks.select("case_id", "document_id", "chunk_id", "text", "speaker", "chunk_confidence"), "document_id", "chunk_id").where("length(text) > 0")
    ready = own.select("case_id", "document_id", "chunk_id", "text", F.coalesce("chunk_confidence", F.lit(1.0)).alias("score"), role_of(F.col("speaker")).alias("role"))
    found = ready.mapInPandas(lambda fs: _scan(fs, find, source), ENTITY)
    key = scores.entity_key(*[F.col(c) for c in ("document_id", "chunk_id", "entity_type", "start_char", "end_char", "source")])
    return found.withColumn("entity_id", key)


def merge(rules: DataFrame, model: DataFrame) -> DataFrame:
    """All rule entities, and those of a model that overlap none of them in their chunk."""
    at = ["document_id", "chunk_id"]
    spans = rules.select(*at, F.col("start_char").alias("a"), F.col("end_char").alias("b"))
    free = model.join(spans, (model["document_id"] == spans["document_id"]) & (model["chunk_id"] == spans["chunk_id"]) & (model["end_char"] > spans["a"]) & (model["start_char"] < spans["b"]), "left_anti")
    return rules.unionByName(free, allowMissingColumns=True)


def model_type(label: Column) -> Column:
    """Entity type of a model's label; null for labels without one."""
    return F.create_map(*[F.lit(x) for pair in MODEL_LABELS.items() for x in pair])[F.upper(label)]


def listed_entities(ner_results: DataFrame) -> DataFrame:
    """Entities of ner_results as rows ``case_id, document_id, chunk_id, pos, entity_type, text, start_char, end_char, confidence, role``."""
    own = once(ner_results.select("case_id", "document_id", "chunk_id", "entities"), "document_id", "chunk_id")
    return own.select("case_id", "document_id", "chunk_id", F.posexplode("entities").alias("pos", "e")).select("case_id", "document_id", "chunk_id", "pos", "e.entity_type", "e.text", "e.start_char", "e.end_char", "e.confidence", "e.role")
