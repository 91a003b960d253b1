"""Evidence for a question: entities asked for, context, limitations, answer and its confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores

# Capitalised words that open a question and are no names, and the texts of an answer without evidence or of a context that was cut.
QUESTION_WORDS = ("Who", "What", "When", "Where", "Why", "How", "Did", "Does", "Was", "Were", "Is", "Are", "The", "A", "An", "To", "From", "With")
NO_EVIDENCE = "No relevant evidence found."
NO_ANSWER = "The available evidence does not contain sufficient information to answer this question."
CUT_NOTE = "\n[Context truncated due to length]"


def asked_entities(question: Column) -> Column:
    """Capitalised words of a question that aren't question words."""
    words = F.transform(F.split(question, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"""^[?.,!"']+|[?.,!"']+\z""", ""))
    return F.filter(words, lambda w: (w != "") & ~w.isin(*QUESTION_WORDS) & w.rlike(r"^\p{Lu}"))


def truncated(context: Column, most_tokens: int = 4000, per_token: int = 4) -> Column:
    """Context cut to its limit, back to the last source that starts inside it, with a note."""
    most = most_tokens * per_token
    head = F.substring(context, 1, most)
    sources = F.split(head, "\n\\[Source", -1)
    back = F.when(F.size(sources) > 1, F.array_join(F.slice(sources, 1, F.size(sources) - 1), "\n[Source")).otherwise(head)
    return F.when(F.length(context) <= most, context).otherwise(F.concat(F.when(F.length(back) > 0, back).otherwise(head), F.lit(CUT_NOTE)))


def source_lines(ranked: DataFrame) -> DataFrame:
    """``query_id, section`` of ranked sources ``query_id, rank, chunk, speaker, text``."""
    speaker = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit(" (Speaker: "), "speaker", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("\n[Source "), F.col("rank").cast("string"), F.lit(": "), F.col("chunk"), F.lit("]"), speaker, F.lit('\n"'), F.coalesce("text", F.lit("")), F.lit('"'))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return ranked.groupBy("query_id").agg(F.concat(F.lit("RETRIEVED EVIDENCE:\n"), F.array_join(rows, "\n")).alias("section"), F.count(F.lit(1)).alias("n"))


def fact_lines(facts: DataFrame) -> DataFrame:
    """``query_id, section`` of distinct facts ``query_id, subject, predicate, object``."""
    line = F.concat(F.lit("- "), F.concat_ws(" ", "subject", "predicate", "object"))
    return facts.groupBy("query_id").agg(F.concat(F.lit("\nKNOWN RELATIONSHIPS:\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n")).alias("section"))


def event_lines(events: DataFrame) -> DataFrame:
    """``query_id, section`` of events ``query_id, ts, description`` in order of time."""
    line = F.concat(F.lit("- ["), "ts", F.lit("] "), "description")
    return events.groupBy("query_id").agg(F.concat(F.lit("\nTIMELINE:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", line.alias("line")))), lambda x: x["line"]), "\n")).alias("section"))


def evidence(sources: Column, facts: Column, events: Column) -> Column:
    """Sections that are there, one under the other; a note if none is."""
    joined = F.concat_ws("\n", sources, facts, events)
    return F.when(joined == "", NO_EVIDENCE).otherwise(joined)


def limitations(*lists: Column) -> Column:
    """All limitations once, in the order in which they first appear."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(x, none) for x in lists]))


def gap_limitation(start: Column, end: Column, minutes: Column, severity: Column) -> Column:
    return F.concat(F.lit("Timeline contains a "), minutes.cast("string"), F.lit("-minute gap between "), start, F.lit(" and "), end, F.lit(" ("), severity, F.lit(")"))


def contradiction_limitation(severity: Column, explanation: Column, kind: Column) -> Column:
    return F.when(F.coalesce(explanation, F.lit("")) != "", F.concat(F.lit("Evidence contradiction ("), F.coalesce(severity, F.lit("")), F.lit("): "), explanation)).otherwise(F.concat(F.lit("Evidence contradiction detected: "), F.coalesce(kind, F.lit("CONFLICT"))))


def conflict_limitation(ts: Column) -> Column:
    return F.concat(F.lit("Conflicting information at "), ts)


# The texts of limitations (above) and of the answer that only points to its sources.
def stub_answer(n_sources: Column, notes: Column) -> Column:
    """Answer that only points to its sources (three at most) and the first two limitations."""
    refs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n_sources, F.lit(3)))), lambda i: F.concat(F.lit("- See [Source "), i.cast("string"), F.lit("] for details.")))
    head = F.concat(F.lit("Based on the available evidence ("), n_sources.cast("string"), F.lit(" source(s) reviewed):\n\nThe evidence shows the following relevant information:\n"), F.array_join(refs, "\n"))
    note = F.when(F.size(notes) > 0, F.concat(F.lit("\n\nNote: "), F.array_join(F.slice(notes, 1, 2), "; "))).otherwise("")
    return F.when(n_sources > 0, F.concat(head, note)).otherwise(NO_ANSWER)


def gaps_inside(gaps: DataFrame, events: DataFrame) -> DataFrame:
    """Gaps between the first and last event of each question: ``events`` has ``query_id, case_id, ts``; two events at least."""
    span = events.groupBy("query_id", "case_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    inside = gaps.join(span, "case_id").where((F.col("start") >= F.col("first")) & (F.col("end") <= F.col("last")))
    return inside.select("query_id", gap_limitation(F.col("start"), F.col("end"), F.col("minutes"), F.col("severity")).alias("limitation"))


def answer(ranked: DataFrame, facts: DataFrame, events: DataFrame, contradictions: DataFrame, gaps: DataFrame, generate: Callable[[Column, Column], Column] | None = None, conflicts: DataFrame | None = None) -> DataFrame:
    """One row per question with sources: ``query_id, n_sources, context, limitations, answer, confidence``.

    ``contradictions`` has ``query_id, severity, explanation, type``, ``gaps``
    and ``conflicts`` have ``query_id, limitation``. A critical contradiction
    halves the confidence. ``generate`` may turn context and limitations
    into an answer (a language model behind a function); the default points to
    the sources.
    """
    order = lambda df: df.groupBy("query_id").agg(F.array_sort(F.collect_set("limitation")).alias("notes"))
    critical = contradictions.groupBy("query_id").agg(F.bool_or(F.coalesce(F.col("severity") == "CRITICAL", F.lit(False))).alias("critical"))
    clashes = order(conflicts if conflicts is not None else gaps.where("false")).withColumnRenamed("notes", "conflict_notes")
    told = order(contradictions.select("query_id", contradiction_limitation(F.col("severity"), F.col("explanation"), F.col("type")).alias("limitation")))
    missing = order(gaps)
    rows = (
        source_lines(ranked).withColumnRenamed("section", "sources").join(fact_lines(facts).withColumnRenamed("section", "facts"), "query_id", "left")
        .join(event_lines(events).withColumnRenamed("section", "events"), "query_id", "left").join(missing.withColumnRenamed("notes", "gap_notes"), "query_id", "left").join(told, "query_id", "left")
        .join(clashes, "query_id", "left").join(critical, "query_id", "left")
    )
    full = rows.select("query_id", F.col("n").alias("n_sources"), truncated(evidence(F.col("sources"), F.col("facts"), F.col("events"))).alias("context"), limitations(F.col("gap_notes"), F.col("notes"), F.col("conflict_notes")).alias("limitations"), F.when(F.coalesce("critical", F.lit(False)), 0.5).otherwise(1.0).alias("factor"), F.col("notes").isNotNull().alias("opposed"), F.col("gap_notes").isNotNull().alias("gapped"))
    made = (generate or (lambda context, notes: stub_answer(F.col("n_sources"), notes)))(F.col("context"), F.col("limitations"))
    return full.select("query_id", "n_sources", "context", "limitations", made.alias("answer"), scores.answer_confidence(F.col("n_sources"), F.col("opposed"), F.col("gapped")).alias("confidence"), "factor").withColumn("confidence", F.round(F.col("confidence") * F.col("factor"), 4)).drop("factor")


def best_chunks(hits: DataFrame, k: int = 5) -> DataFrame:
    """The k best of scored hits ``query_id, key, score``, with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def source_map(ranked: DataFrame) -> DataFrame:
    """``query_id, sources``: map from rank to chunk."""
    return ranked.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rank", "chunk")))).alias("sources"))


def user_prompt(question: Column, context: Column, notes: Column) -> Column:
    """What a language model is asked: the evidence, the limitations if there are any, and the question."""
    known = F.when(F.size(notes) > 0, F.concat(F.lit("\n\nKnown limitations:\n- "), F.array_join(notes, "\n- "))).otherwise("")
    return F.concat(F.lit("Evidence:\n"), context, known, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer only from the evidence and name the sources."))
