"""Contradictions between chunks of a case that share an entity.

A chunk is first reduced to what the rules ask of it (cues, places, times), so
no text travels with a pair. All chunks of an entity are compared as classes, at
most 64 of equal cues and one for each distinct set of places or of times, with
the members of each class in tables of their own; ``detect`` asks all rules of
pairs that are given, ``search`` of all pairs of chunks that share an entity.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as T
from ..session import materialize
from .base import once
from .order import Ordered


def claims(chunks: DataFrame) -> DataFrame:
    """What the rules need to know of each chunk."""
    own = once(chunks.select("case_id", "document_id", "chunk_id", "text", "chunk_confidence"), "document_id", "chunk_id").where("text is not null")
    t = F.col("text")
    low = F.lower(t)
    return own.select(
        "case_id", "document_id", "chunk_id", F.concat_ws("/", "document_id", "chunk_id").alias("key"), F.coalesce("chunk_confidence", F.lit(1.0)).alias("confidence"),
        T.has_denial(t).alias("denies"), T.has_assertion(t).alias("asserts"), F.array_sort(F.array_distinct(F.transform(T.place_mentions(t), lambda x: F.trim(x)))).alias("places"),
        F.array_sort(F.array_distinct(F.transform(T.time_mentions(t), lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))))).alias("times"),
        T.contains_any(t, T.EVIDENCE_WORDS).alias("physical"), T.contains_any(t, T.DENIAL_WORDS).alias("negates"), low.contains("home").alias("home"), low.contains("scene").alias("scene"),
        F.array_distinct(F.split(F.regexp_replace(low, r"(?U)[^\w]+", " "), " ")).alias("words"),
    )


def mentions(entities: DataFrame, types: tuple[str, ...] = ("PERSON", "WITNESS", "SUSPECT")) -> DataFrame:
    """``case_id, key, entity, head``: distinct entities of each chunk, with their first word."""
    name = scores.name_key(F.col("text"))
    own = entities.where(F.col("entity_type").isin(*types) & F.col("text").isNotNull()).select("case_id", F.concat_ws("/", "document_id", "chunk_id").alias("key"), name.alias("entity")).where("entity <> ''").distinct()
    return own.withColumn("head", F.split("entity", " ")[0])


#: What the rules on cues ask of a chunk; chunks that agree in all of it are one class.
CUES = ("denies", "asserts", "physical", "negates", "home", "scene")


#: The rules on sets of values; chunks with equal sets are one class.
VALUES = {"LOCATION_CONFLICT": "places", "TIME_CONFLICT": "times"}


def _named(entities: DataFrame, chunks: DataFrame, *columns: str | Column, least: float = 0.5, **options) -> DataFrame:
    """Chunks of a confidence of at least ``least`` under each entity whose first word they hold."""
    own = claims(chunks).where(F.col("confidence") >= least).select("key", "words", "confidence", *columns)
    # Entities are gathered by chunk, so that what is known of a chunk meets them in one row.
    listed = mentions(entities, **options).groupBy("key").agg(F.collect_list(F.struct("case_id", "entity", "head")).alias("named"))
    held = F.filter("named", lambda e: F.array_contains("words", F.regexp_replace(e["head"], r"(?U)[^\w]+", "")))
    met = own.join(listed, "key").withColumn("named", held).drop("words")
    return met.withColumn("e", F.explode("named")).select("e.case_id", "e.entity", "key", "confidence", *[F.col(c) for c in met.columns if c not in ("key", "confidence", "named")])


def _class() -> Column:
    return sum((F.col(c).cast("int") * (1 << i) for i, c in enumerate(CUES)), F.lit(0)).alias("class")


def membership(entities: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """Class of each chunk under each entity it names: ``case_id, entity, key, class, confidence``.

    A class is a number made of the cues, so an entity has at most 64. Chunks
    below a confidence of ``least`` are left out, as no pair with them is found.
    """
    return _named(entities, chunks, _class(), **options).select("case_id", "entity", "key", "class", "confidence")


def _valued(named: DataFrame) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.col(v).alias("values")) for k, v in VALUES.items()])
    return named.select("case_id", "entity", "key", "confidence", F.explode(kinds).alias("v")).select("case_id", "entity", "key", "confidence", "v.type", "v.values").where(F.size("values") > 0)


def value_membership(entities: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """Class of each chunk by its places and by its times: ``case_id, entity, type, class_key, key, confidence``.

    A class is told by its least key, which is also its representative in ``class_pairs``.
    """
    own = _valued(_named(entities, chunks, *VALUES.values(), **options))
    least = own.groupBy("case_id", "entity", "type", "values").agg(F.min("key").alias("class_key"))
    return own.join(least, ["case_id", "entity", "type", "values"]).select("case_id", "entity", "type", "class_key", "key", "confidence")


def class_pairs(entities: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """Pairs of classes of chunks that contradict each other about an entity: ``case_id, entity, type, class_a, class_b, key_a, key_b, n_a, n_b``.

    With ``membership`` this says of every pair of chunks whether its cues
    contradict (denial against assertion, statement against evidence), and with
    ``value_membership`` whether its places or its times do (both have some, and
    none in common), without a row for each: any chunk of one class does with
    any of the other. Keys are representatives, ``n`` counts the members. Pairs
    by places or times have no direction and stand once, key_a before key_b,
    without class numbers.
    """
    named = materialize(_named(entities, chunks, _class(), *VALUES.values(), **options), "claims")
    groups = named.groupBy("case_id", "entity", "class").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    side = lambda s: groups.select("case_id", "entity", *[F.col(c).alias(f"{c}_{s}") for c in ("class", "key", "n")])
    met = side("a").join(side("b"), ["case_id", "entity"])
    has = lambda s, cue: F.col(f"class_{s}").bitwiseAND(1 << CUES.index(cue)) > 0
    denial = has("a", "denies") & has("b", "asserts")
    evidence = has("a", "physical") & ~has("b", "physical") & has("b", "denies")
    kinds = F.array_compact(F.array(F.when(denial & ((F.col("class_a") != F.col("class_b")) | (F.col("n_a") > 1)), "DENIAL_VS_ASSERTION"), F.when(evidence, "STATEMENT_VS_EVIDENCE")))
    by_cues = met.select("case_id", "entity", F.explode(kinds).alias("type"), "class_a", "class_b", "key_a", "key_b", "n_a", "n_b")
    sets = _valued(named).groupBy("case_id", "entity", "type", "values").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    other = lambda s: sets.select("case_id", "entity", "type", *[F.col(c).alias(f"{c}_{s}") for c in ("values", "key", "n")])
    apart = other("a").join(other("b"), ["case_id", "entity", "type"]).where((F.col("key_a") < F.col("key_b")) & ~F.arrays_overlap("values_a", "values_b"))
    none = F.lit(None).cast("int")
    return by_cues.unionByName(apart.select("case_id", "entity", "type", none.alias("class_a"), none.alias("class_b"), "key_a", "key_b", "n_a", "n_b"))


def _spoken(chunks: DataFrame) -> DataFrame:
    own = once(chunks.select("case_id", "document_id", "chunk_id", "text", "speaker"), "document_id", "chunk_id")
    return own.select("case_id", F.concat_ws("/", "document_id", "chunk_id").alias("key"), F.lower(F.coalesce("text", F.lit(""))).alias("low"), F.nullif("speaker", F.lit("")).alias("speaker"))


def speaker_members(chunks: DataFrame) -> DataFrame:
    """Chunks spoken under each label: ``case_id, label, key``."""
    return _spoken(chunks).where("speaker is not null").select("case_id", F.col("speaker").alias("label"), "key")


def speaker_mentions(chunks: DataFrame) -> DataFrame:
    """Chunks that name the speaker of others: ``case_id, label, key, n``.

    Without named entities, a chunk shares a speaker with all chunks spoken under
    a label that stands in its text, or whose first name does if it has a label
    itself; ``n`` counts them. Together with ``speaker_members`` this says it of
    every pair of chunks without a row for each. The labels of a case are
    distinct and few, and meet its chunks by case.
    """
    own = _spoken(chunks)
    label = F.lower("speaker")
    labels = own.where("speaker is not null").groupBy("case_id", F.col("speaker").alias("label"), label.alias("whole"), F.split(label, r"(?U)\s+")[0].alias("head")).agg(F.count(F.lit(1)).alias("n"))
    met = own.join(labels, "case_id").where(F.col("low").contains(F.col("head")) & (F.col("speaker").isNotNull() | F.col("low").contains(F.col("whole"))))
    others = F.col("n") - F.col("speaker").eqNullSafe(F.col("label")).cast("int")
    return met.select("case_id", "label", "key", others.alias("n")).where("n > 0")


def speaker_pairs(mentions_: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs behind some mentions, as candidates for ``detect``: ``case_id, key_a, key_b, shared``, as many as chunks times chunks at most."""
    met = mentions_.select("case_id", "label", "key").join(members.select("case_id", "label", F.col("key").alias("by")), ["case_id", "label"]).where("key <> by")
    return met.groupBy("case_id", F.least("key", "by").alias("key_a"), F.greatest("key", "by").alias("key_b")).agg(F.array_sort(F.collect_set("label")).alias("shared"))


#: Members of an entity that meet as one block; of larger groups each block meets each in a task of its own.
BLOCK = 2048
#: Pairs of members that one task may meet.
TASK_PAIRS = 1 << 22


def _bits(values: Column) -> Column:
    """64 bits of a list: lists without a common bit have no value in common, others may."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def _disjoint(name: str, bits: str) -> Column:
    """Whether the lists of both sides have nothing in common; looked at only where a bit is."""
    return (F.col(f"{bits}_a").bitwiseAND(F.col(f"{bits}_b")) == 0) | ~F.arrays_overlap(f"{name}_a", f"{name}_b")


def search(entities: DataFrame, chunks: DataFrame, least: float = 0.5, times: DataFrame | None = None, block: int = BLOCK, task_pairs: int = TASK_PAIRS, **options) -> DataFrame:
    """``detect`` of all pairs of chunks of a case that share an entity: a row with confidence and severity for each, so as many as the square of an entity's chunks.

    Chunks meet under each entity whose first word they hold, and a pair counts
    under the first of those it shares, which is what its rules are about; so it
    is known where it is met, and no pair is written or sent to another task.
    """
    own = claims(chunks).where(F.col("confidence") >= least)
    # Entities are gathered by chunk, so that what is known of a chunk meets them in one row.
    listed = mentions(entities, **options).groupBy("case_id", "key").agg(F.array_sort(F.collect_list(F.struct("entity", "head"))).alias("named"))
    met = own.drop("case_id").join(listed.where("case_id is not null"), "key")
    met = met.join(times.groupBy("key").agg(F.max("ts").alias("ts")), "key", "left") if times is not None else met.withColumn("ts", F.lit(None).cast("string"))
    held = F.filter("named", lambda e: F.array_contains("words", F.regexp_replace(e["head"], r"(?U)[^\w]+", "")))
    plain = met.withColumn("held", F.transform(held, lambda e: e["entity"])).where(F.size("held") > 0).select(
        "case_id", "key", "confidence", F.round("confidence", 6).alias("rounded"), *CUES, "ts", *[c for v in VALUES.values() for c in (v, _bits(F.col(v)).alias(f"{v}_bits"))],
        "held", F.transform("named", lambda e: e["entity"]).alias("shared"),
    )
    named = materialize(plain, "claims")
    groups = named.select("case_id", F.explode("held").alias("about")).groupBy("case_id", "about").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    pairs = groups.agg(F.sum(n.cast("double") * n)).first()[0] or 0
    large = groups.where(n > block).select("case_id", "about", F.ceil(n / block).cast("int").alias("of"))  # at most one for ``block`` members
    each = named.select("*", F.posexplode("held").alias("at", "about")).withColumns({
        "before": F.slice("held", F.lit(1), F.col("at")), "before_bits": _bits(F.slice("held", F.lit(1), F.col("at"))), "other_bits": _bits(F.array_remove("shared", F.col("about"))),
    }).drop("held", "at")
    placed = each.join(F.broadcast(large), ["case_id", "about"], "left").withColumn("of", F.coalesce("of", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("key"), "of").cast("int"))
    tasks = max(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / task_pairs))
    on = ["case_id", "about", "block_a", "block_b"]

    def side(s: str, t: str) -> DataFrame:
        mine = placed.withColumn(f"block_{t}", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).withColumnRenamed("block", f"block_{s}").drop("of")
        return mine.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in mine.columns if c not in on]).repartition(tasks, *on)

    both = side("a", "b").join(side("b", "a").hint("merge"), on).where((F.col("key_a") < F.col("key_b")) & _disjoint("before", "before_bits"))
    shared = F.when(F.col("other_bits_a").bitwiseAND(F.col("other_bits_b")) == 0, F.array("about")).otherwise(F.array_intersect("shared_a", "shared_b"))
    apart = lambda x: (F.col(f"{x}_bits_a") != 0) & (F.col(f"{x}_bits_b") != 0) & _disjoint(x, f"{x}_bits")
    # Both confidences are high enough by now, and a confirmed one is CONFIRMED at least.
    return _ruled(both.withColumn("shared", shared).withColumn("same", F.coalesce(F.col("ts_a") == F.col("ts_b"), F.lit(False))), apart, least if least > CONFIRMED else None)


def pair_score(deny_a: Column, deny_b: Column, home_a: Column, scene_a: Column, home_b: Column, scene_b: Column) -> Column:
    """Score of opposition: 0.3 if one side negates, 0.4 if one is at home and the other at the scene."""
    return F.when(deny_a != deny_b, 0.3).otherwise(0.0) + F.when((home_a & scene_b) | (scene_a & home_b), 0.4).otherwise(0.0)


def _opposed(score: Column) -> tuple[Column, Column]:
    label = F.when(score > 0.5, "contradiction").when(score > 0.2, "neutral").otherwise("entailment")
    return label, F.when(score > 0.5, F.least(score, F.lit(0.95))).when(score > 0.2, F.lit(0.6)).otherwise(F.lit(0.5))


def opposition(score: Column) -> Column:
    """``struct(label, confidence)`` of a score."""
    label, confidence = _opposed(score)
    return F.struct(label.alias("label"), confidence.alias("confidence"))


def detect(pairs: DataFrame, chunks: DataFrame, times: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Contradictions of candidate pairs: ``case_id, key_a, key_b, type, shared, explanation, confidence, severity, label``.

    Four rules are asked of each pair (denial against assertion, different
    places, different times, statement against evidence), each about the first
    shared entity whose first word stands in both texts. ``times`` may give the
    last timestamp of a chunk (``key, ts``); equal ones make a place conflict
    graver.
    """
    c = claims(chunks).withColumn("rounded", F.round("confidence", 6))
    side = lambda s: c.select([F.col(x).alias(f"{x}_{s}") for x in c.columns if x != "case_id"])
    met = pairs.join(side("a"), "key_a").join(side("b"), "key_b")
    if times is not None:
        at = times.groupBy("key").agg(F.max("ts").alias("ts"))
        met = met.join(at.select(F.col("key").alias("key_a"), F.col("ts").alias("ts_a")), "key_a", "left").join(at.select(F.col("key").alias("key_b"), F.col("ts").alias("ts_b")), "key_b", "left")
        same = F.coalesce(F.col("ts_a") == F.col("ts_b"), F.lit(False))
    else:
        same = F.lit(False)
    both = F.array_intersect("words_a", "words_b")
    head = lambda e: F.split(e, " ")[0]
    bare = lambda e: F.regexp_replace(head(e), r"(?U)[^\w]+", "")
    about = F.try_element_at(F.filter("shared", lambda e: F.array_contains(both, bare(e))), F.lit(1))
    met = met.withColumn("about", about).withColumn("same", same).where("about is not null")
    apart = lambda x: (F.size(f"{x}_a") > 0) & (F.size(f"{x}_b") > 0) & (F.size(F.array_intersect(f"{x}_a", f"{x}_b")) == 0)
    return _ruled(met, apart, least)


#: Confidence of a pair score from which it counts in the confidence of the pair.
CONFIRMED = 0.7


def _ruled(met: DataFrame, apart: Callable[[str], Column], least: float | None) -> DataFrame:
    """The four rules for pairs with what is known of both sides, ``about``, ``shared`` and ``same``; ``apart`` tells whether both have values and none in common."""
    rules = F.array(
        F.when(F.col("denies_a") & F.col("asserts_b"), 0).when(F.col("denies_b") & F.col("asserts_a"), 1),
        F.when(apart("places"), 2), F.when(apart("times"), 3),
        F.when((F.col("physical_a") != F.col("physical_b")) & F.when(F.col("physical_a"), F.col("denies_b")).otherwise(F.col("denies_a")), 4),
    )
    scored = met.withColumn("score", pair_score(*[F.col(x) for x in ("negates_a", "negates_b", "home_a", "scene_a", "home_b", "scene_b")]))
    label, nli = _opposed(F.col("score"))
    confirmed = (label == "contradiction") & (nli >= CONFIRMED)
    # Rounding keeps order, so the lowest of rounded values is the lowest one rounded.
    confidence, rounded = F.least("confidence_a", "confidence_b", F.when(confirmed, nli)), F.least("rounded_a", "rounded_b", F.when(confirmed, F.round(nli, 6)))
    found = scored.select(
        "case_id", "key_a", "key_b", "shared", "same", "about", *[f"{v}_{s}" for v in VALUES.values() for s in "ab"], confidence.alias("confidence"), rounded.alias("rounded"),
        label.alias("label"), F.explode(rules).alias("rule"),
    ).where("rule is not null")
    if least is not None:
        found = found.where(F.col("confidence") >= least)
    rule, e = F.col("rule"), F.col("about")
    kind = F.array(*map(F.lit, ("DENIAL_VS_ASSERTION", "DENIAL_VS_ASSERTION", *VALUES, "STATEMENT_VS_EVIDENCE")))[rule]
    first = lambda x: (F.col(f"{x}_a")[0], F.lit(" vs "), F.col(f"{x}_b")[0], F.lit("."))
    why = (
        F.when(rule == 0, F.concat(F.lit("Chunk A denies while Chunk B asserts about "), e, F.lit(".")))
        .when(rule == 1, F.concat(F.lit("Chunk B denies while Chunk A asserts about "), e, F.lit(".")))
        .when(rule == 2, F.concat(e, F.lit(" claimed "), *first("places")))
        .when(rule == 3, F.concat(e, F.lit(" has conflicting times: "), *first("times")))
        .otherwise(F.concat(F.lit("Statement denies evidence regarding "), e, F.lit(".")))
    )
    return found.select(
        "case_id", "key_a", "key_b", kind.alias("type"), "shared", why.alias("explanation"), F.col("rounded").alias("confidence"),
        scores.severity(kind, F.col("confidence"), F.size("shared"), F.col("same")).alias("severity"), "label",
    )


def numbered(found: DataFrame) -> DataFrame:
    """With ids ``CONT_case_0000`` in the order of pairs and types."""
    placed = Ordered(found, ["case_id"], ["key_a", "key_b", "type"]).number("n")
    return placed.withColumn("contradiction_id", scores.numbered("CONT", F.col("case_id"), F.col("n") - 1)).drop("n")


def summary(stored: DataFrame) -> DataFrame:
    """Stored contradictions by case, type and severity; repeated rows count once."""
    own = stored.dropDuplicates(["case_id", "contradiction_id"])
    return own.groupBy("case_id", "type", "severity").agg(F.count(F.lit(1)).alias("n"))


def of_chunks(stored: DataFrame, chunk_keys: DataFrame) -> DataFrame:
    """Stored contradictions with either chunk among ``document_id, chunk_id``."""
    own = stored.dropDuplicates(["case_id", "contradiction_id"])
    wanted = chunk_keys.select("document_id", "chunk_id").distinct()
    side = lambda s: own.join(wanted, (own[f"{s}.document_id"] == wanted["document_id"]) & (own[f"{s}.chunk_id"] == wanted["chunk_id"]), "left_semi")
    return side("chunk_a").unionByName(side("chunk_b")).dropDuplicates(["case_id", "contradiction_id"])


def severities(stored: DataFrame) -> DataFrame:
    """Severity by the rules next to the stored one: ``contradiction_id, case_id, stored, computed, critical``."""
    own = stored.dropDuplicates(["case_id", "contradiction_id"])
    computed = scores.severity(F.col("type"), F.col("confidence"), F.coalesce(F.size("shared_entities"), F.lit(0)), F.lit(False))
    return own.select("contradiction_id", "case_id", F.col("severity").alias("stored"), computed.alias("computed"), F.coalesce(F.col("severity") == "CRITICAL", F.lit(False)).alias("critical"))


def opposed_texts(stored: DataFrame) -> DataFrame:
    """Heuristic label of every stored pair of texts: ``contradiction_id, case_id, label, confidence``."""
    own = stored.dropDuplicates(["case_id", "contradiction_id"])
    a, b = F.col("chunk_a.text"), F.col("chunk_b.text")
    says = lambda t, w: F.coalesce(F.lower(t).contains(w), F.lit(False))
    score = pair_score(T.contains_any(a, T.DENIAL_WORDS), T.contains_any(b, T.DENIAL_WORDS), says(a, "home"), says(a, "scene"), says(b, "home"), says(b, "scene"))
    return own.select("contradiction_id", "case_id", opposition(score).alias("o")).select("contradiction_id", "case_id", "o.label", F.round("o.confidence", 6).alias("confidence"))


def judged(stored: DataFrame, least: float = 0.5) -> DataFrame:
    """The rules asked of every stored pair of texts; keys are the contradiction's id with /a and /b."""
    own = stored.dropDuplicates(["case_id", "contradiction_id"]).where("contradiction_id is not null")
    side = lambda s: own.select("case_id", F.col("contradiction_id").alias("document_id"), F.lit(s).alias("chunk_id"), F.col(f"chunk_{s}.text").alias("text"), F.col("confidence").alias("chunk_confidence"))
    shared = F.array_sort(F.filter(F.transform(F.coalesce("shared_entities", F.array().cast("array<string>")), scores.name_key), lambda e: e.isNotNull() & (e != "")))
    pairs = own.select("case_id", F.concat("contradiction_id", F.lit("/a")).alias("key_a"), F.concat("contradiction_id", F.lit("/b")).alias("key_b"), shared.alias("shared"))
    return detect(pairs, side("a").unionByName(side("b")), least=least)
