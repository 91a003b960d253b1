"""Column functions on text: blanks, noise, encoding, sections, speakers, statement cues.

Patterns carry ``(?U)`` so that letters, digits and blanks are those of Unicode.
Every function maps null to null unless it says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- blanks -----------------------------------------------------------------


def strip(text: Column) -> Column:
    """Without blanks (of any kind) at either end; ``trim`` would only take spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def squash(text: Column) -> Column:
    """Stripped, with every run of blanks as one space."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def comparable(text: Column) -> Column:
    """Lower case, squashed: the form in which repeated lines are compared."""
    return F.lower(squash(text))


def normalize_whitespace(text: Column, spaces: bool = True, newlines: bool = True, runs: bool = True, ends: bool = True) -> Column:
    """Line ends to ``\\n``, runs of spaces to one, three or more line ends to two, no spaces round line ends, stripped."""
    if newlines:
        text = F.regexp_replace(text, r"\r\n?", "\n")
    if spaces:
        text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n")
    if runs:
        text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text) if ends else text


# --- noise ------------------------------------------------------------------


def normalize_page_breaks(text: Column) -> Column:
    return F.regexp_replace(text, r"[\f\x0B]+", "\n")


def remove_isolated_marks(text: Column) -> Column:
    """Without runs of recognition marks that stand alone between blanks."""
    return F.regexp_replace(text, r"(?mdU)(?:^|(?<=\s))[|~¬¦]+(?=\s|$)", "")


def shorten_punctuation(text: Column) -> Column:
    """Five or more equal marks in a row become three."""
    return F.regexp_replace(text, r"([.…\-_=])\1{4,}", "$1$1$1")


def remove_garbled(text: Column) -> Column:
    """Without runs of three or more unusual symbols."""
    return F.regexp_replace(text, r"""(?U)[^\w\s,.!?;:'"()\[\]{}<>@#$%&*+=/\\-]{3,}""", "")


def remove_noise(text: Column, aggressive: bool = False) -> Column:
    text = shorten_punctuation(remove_isolated_marks(normalize_page_breaks(text)))
    return remove_garbled(text) if aggressive else text


# --- encoding ---------------------------------------------------------------


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no builtin for it."""
    return text.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t))


def drop_controls(text: Column) -> Column:
    """Without control characters (but tab and line ends), private, unassigned and surrogate code points, and U+FFFD."""
    return F.regexp_replace(text, "[\\p{Cn}\\p{Co}\\p{Cs}�]|[\\p{Cc}&&[^\\t\\n\\r]]", "")


def fix_encoding(text: Column) -> Column:
    odd = text.rlike(r"[^\x00-\x7F]")  # plain letters have only one form, and so need not go through Python
    return drop_controls(F.when(odd, nfc(F.when(odd, text))).otherwise(text))


def clean_text(text: Column) -> Column:
    """Encoding, then blanks, then noise; no second pass over blanks."""
    return remove_noise(normalize_whitespace(fix_encoding(text)))


# --- page furniture and sections -------------------------------------------

# Forms of a page number on a stripped line.
PAGE_NUMBER_PATTERNS = (
    r"(?iU)^\s*page\s+\d+\s*(?:of|/)\s*\d+\s*$",
    r"(?U)^\s*[-—]+\s*\d+\s*[-—]+\s*$",
    r"(?U)^\s*\d+\s*$",
    r"(?iU)^\s*[\[(]?\s*page\s*\d+\s*[\])]?\s*$",
    r"(?U)^\s*\d+\s*\|\s*.+$|^.+\s*\|\s*\d+\s*$",
)


def is_page_number(text: Column) -> Column:
    """False for null."""
    bare = strip(text)
    found = F.lit(False)
    for pattern in PAGE_NUMBER_PATTERNS:
        found = found | bare.rlike(pattern)
    return F.coalesce(found & (bare != ""), F.lit(False))


# Headings of sections.
SECTION_KEYWORDS = (
    "STATEMENT", "WITNESS STATEMENT", "VICTIM STATEMENT", "INTERVIEW", "INTERROGATION", "DEPOSITION", "TESTIMONY", "DECLARATION",
    "SUMMARY", "EXECUTIVE SUMMARY", "SYNOPSIS", "OVERVIEW", "INTRODUCTION", "BACKGROUND", "OBSERVATIONS", "FINDINGS", "ANALYSIS",
    "CONCLUSION", "CONCLUSIONS", "RECOMMENDATIONS", "EVIDENCE", "EXHIBITS", "PHYSICAL EVIDENCE", "DOCUMENTARY EVIDENCE", "ATTACHMENTS",
    "APPENDIX", "APPENDICES", "NARRATIVE", "INCIDENT NARRATIVE", "FACTS", "STATEMENT OF FACTS", "CHRONOLOGY", "TIMELINE",
    "SEQUENCE OF EVENTS", "CASE INFORMATION", "CASE DETAILS", "INCIDENT DETAILS", "RESPONDING OFFICERS", "OFFICERS PRESENT",
    "PARTIES INVOLVED", "WITNESSES", "SUSPECTS", "VICTIMS", "DISPOSITION", "REFERRALS", "FOLLOW-UP", "NEXT STEPS", "CERTIFICATION", "SIGNATURES",
)

# Forms of a heading; group 1 is its name.
SECTION_PATTERNS = (
    r"(?U)^(?:\d+\.|\(?[IVXLC]+[.)])\s*([A-Z][A-Z\s]+)$",
    r"(?U)^(?:[A-Z][.)]\s*|\([a-z]\)\s*)([A-Z][A-Z\s]+)$",
    r"(?iU)^SECTION\s*:\s*([A-Z][A-Z\s]+)$",
    r"(?U)^([A-Z][A-Z\s]+)\s*[-=]{3,}$",
)


def is_all_caps(text: Column) -> Column:
    """Nine letters in ten are capitals; false without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.coalesce((letters > 0) & (F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) >= 0.9 * letters), F.lit(False))


def section_label(text: Column) -> Column:
    """Heading in its normal form: without marks at its ends, squashed, upper case."""
    return F.upper(squash(F.regexp_replace(strip(text), r"^[.:;\-–—]+|[.:;\-–—]+\z", "")))


def section_name(text: Column, longest: int = 50) -> Column:
    """Name of the section that a line opens, or null if it is no heading."""
    bare = strip(text)
    label = section_label(bare)
    chosen = F.when(label.isin(*SECTION_KEYWORDS), label)
    for pattern in SECTION_PATTERNS:
        chosen = chosen.when(bare.rlike(pattern), section_label(F.regexp_extract(bare, pattern, 1)))
    chosen = chosen.when((F.length(bare) <= 30) & is_all_caps(bare) & bare.rlike(r"(?U)^[A-Z][A-Z\s\-–—:.]+$"), label)
    return F.when((bare != "") & (F.length(bare) <= longest), chosen)


# --- speakers ---------------------------------------------------------------

# Speaker labels at the start of a block, most specific first.
SPEAKER_PATTERNS = (
    r"(?iU)^((?:DET\.?|DETECTIVE|OFFICER|OFC\.?|SGT\.?|SERGEANT|LT\.?|LIEUTENANT|CPT\.?|CAPTAIN|CHIEF|DEPUTY|AGENT|INSPECTOR|INVESTIGATOR)\s+[A-Z][A-Z\s\.\-']+)\s*:\s*",
    r"(?iU)^((?:MR\.?|MRS\.?|MS\.?|MISS|DR\.?|PROF\.?|JUDGE|HON\.?|THE\s+HONORABLE)\s+[A-Z][A-Z\s\.\-']+)\s*:\s*",
    r"(?iU)^(THE\s+(?:COURT|WITNESS|DEFENDANT|PLAINTIFF|PROSECUTOR|DEFENSE|STATE|GOVERNMENT|ACCUSED))\s*:\s*",
    r"(?iU)^(WITNESS|VICTIM|SUSPECT|COMPLAINANT|DEFENDANT|PLAINTIFF|PROSECUTOR|ATTORNEY|COUNSEL|CLERK|BAILIFF|REPORTER)\s*:\s*",
    r"(?iU)^(WITNESS\s*#?\d+)\s*:\s*",
    r"(?iU)^([QA])\s*[.:]\s*",
    r"(?U)^([A-Z][A-Z\s\.\-']{1,30})\s*:\s*",
)


def detect_speaker(text: Column) -> Column:
    """``struct(speaker, rest)``: the label in capitals and the text after it; without a label null and the text as it is."""
    bare = strip(text)
    found = None
    for pattern in SPEAKER_PATTERNS:
        hit = F.struct(F.upper(squash(F.regexp_extract(bare, pattern, 1))).alias("speaker"), strip(F.regexp_replace(bare, pattern, "")).alias("rest"))
        found = F.when(bare.rlike(pattern), hit) if found is None else found.when(bare.rlike(pattern), hit)
    return found.otherwise(F.struct(F.lit(None).cast("string").alias("speaker"), text.alias("rest")))


# Short forms of ranks and titles.
RANKS = (
    ("DET. ", "DETECTIVE "), ("DET ", "DETECTIVE "), ("OFC. ", "OFFICER "), ("OFC ", "OFFICER "), ("SGT. ", "SERGEANT "), ("SGT ", "SERGEANT "), ("LT. ", "LIEUTENANT "), ("LT ", "LIEUTENANT "), ("CPT. ", "CAPTAIN "), ("CPT ", "CAPTAIN "),
    ("DR ", "DR. "), ("MR ", "MR. "), ("MRS ", "MRS. "), ("MS ", "MS. "), ("HON ", "HONORABLE "))


def expand_rank(speaker: Column) -> Column:
    """Label in capitals with its rank written out."""
    label = F.upper(squash(speaker))
    out = None
    for short, full in RANKS:
        value = F.concat(F.lit(full), F.substring(label, len(short) + 1, 10_000))
        out = F.when(label.startswith(short), value) if out is None else out.when(label.startswith(short), value)
    return out.otherwise(label)


def role_of(speaker: Column) -> Column:
    """Role that a label states; null if it states none."""
    label = F.upper(speaker)
    return (
        F.when(label.contains("WITNESS"), "WITNESS").when(label.contains("SUSPECT"), "SUSPECT").when(label.contains("VICTIM"), "VICTIM")
        .when(label.contains("OFFICER") | label.contains("DETECTIVE") | label.contains("DET"), "OFFICER")
    )


# --- statements -------------------------------------------------------------

# Cues of denial and of assertion, on lower case.
DENIALS = (r"\b(?:was\s+not|wasn't|were\s+not|weren't)\b", r"\b(?:did\s+not|didn't)\b", r"\b(?:never|not)\b", r"\b(?:deny|denied|denies)\b", r"\b(?:no\s+way|impossible)\b")
ASSERTIONS = (
    r"\b(?:i\s+was|he\s+was|she\s+was|they\s+were)\b", r"\b(?:i\s+did|he\s+did|she\s+did|they\s+did)\b",
    r"\b(?:i\s+saw|he\s+saw|she\s+saw|they\s+saw)\b", r"\b(?:i\s+have|he\s+has|she\s+has|they\s+have)\b",
)
# Mentions of places and times.
PLACES = (
    r"\b(?:at\s+(?:the\s+)?(?:home|house|office|work|scene|park|store))\b", r"\b(?:in\s+(?:the\s+)?(?:house|room|car|building|street))\b",
    r"\b(?:near|at|inside|outside)\s+\w+",
)
TIMES = (r"\b(?:at\s+)?(\d{1,2}(?::\d{2})?\s*(?:am|pm|AM|PM)?)\b", r"\b(?:around|approximately|about)\s+(\d{1,2}(?::\d{2})?\s*(?:am|pm|AM|PM)?)\b")
# Words of physical evidence, and denial words of the pair score (both matched inside words).
EVIDENCE_WORDS = ("forensic", "dna", "fingerprint", "blood", "evidence", "camera", "cctv", "footage", "record", "log")
DENIAL_WORDS = ("not", "never", "didn't", "wasn't", "weren't", "deny")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any of the patterns, all bounded by words, occurs: one boundary check for all of them."""
    inner = [p.removeprefix(r"\b(?:").removesuffix(r")\b") for p in patterns]
    return F.coalesce(F.lower(text).rlike(r"(?U)\b(?:" + "|".join(inner) + r")\b"), F.lit(False))


def has_denial(text: Column) -> Column:
    return _any(text, DENIALS)


def has_assertion(text: Column) -> Column:
    return _any(text, ASSERTIONS)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words stands in the lower-cased text, also inside a word."""
    return F.coalesce(F.lower(text).rlike("|".join(w.replace("'", "['’]") if "’" in w else w for w in words)), F.lit(False))


def place_mentions(text: Column) -> Column:
    """All mentions of places, pattern by pattern; empty for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(*[F.regexp_extract_all(low, F.lit("(?U)" + p), F.lit(0)) for p in PLACES])


def time_mentions(text: Column) -> Column:
    """All mentions of times, pattern by pattern; empty for null."""
    own = F.coalesce(text, F.lit(""))
    return F.concat(*[F.regexp_extract_all(own, F.lit("(?iU)" + p), F.lit(1)) for p in TIMES])
