"""Subject areas of documents from averaged word and subword embeddings.

A sentence is the average of its words' embeddings, a word the average of the
embeddings of itself and its letter groups; each subject has its own logistic
output. Labels belong to documents, so every sentence of a labelled document
first carries all its labels and later keeps those that the model itself finds
there. Each step, tasks compute the gradient over their share of the sentences;
the driver sums the gradients, moves the parameters and sends them out again.
Every sentence of every document is then scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import bounded
from ..session import discard, materialize, ship_package

#: Labelled documents that training uses at most (chosen by a hash of their id).
MOST_LABELLED = 20_000

#: Steps of training: on labels of 390 documents 30 do better on all others than 60.
STEPS = 30

#: Distinct sentences of a gradient task, and tasks at most: the labelled documents are bounded, and the driver sums what they send (a megabyte each).
TASK_SENTENCES, MOST_TASKS = 3000, 64

_SPLIT = re.compile(r"(?<=[.!?])\s+|\s*[\r\n]+\s*")
_WORD = re.compile(r"[^\W\d_]+")

BUCKETS, DIMENSIONS = 1 << 14, 16
#: A subject is one of a document if at least one in so many sentences deals with it.
SHARE = 8


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words of each sentence with a letter; sentences end at full stops and at line ends."""
    return [w for s in _SPLIT.split(text or "") if (w := _WORD.findall(s.lower()))]


def groups(word: str) -> list[str]:
    """Groups of four and five letters of a word with its ends marked."""
    marked = f"<{word}>"
    return [marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)]


def bucket(group: str) -> int:
    return zlib.crc32(group.encode("utf-8")) % BUCKETS


def features(word: str) -> list[int]:
    """Buckets of a word and of its groups of four and five letters."""
    return [bucket(g) for g in (word, *groups(word))]


class Ragged:
    """Means of rows over lists of indices, and the way back for gradients."""

    def __init__(self, index: np.ndarray, lengths: np.ndarray, n: int) -> None:
        self.index, self.n = index.astype(np.int64), n
        self.start = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        self.lengths = lengths[:, None].astype(np.float64)
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.order = np.argsort(self.index, kind="stable")
        self.used, self.first = np.unique(self.index[self.order], return_index=True)

    def mean(self, rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(rows[self.index], self.start) / self.lengths

    def back(self, gradient: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, gradient.shape[1]))
        out[self.used] = np.add.reduceat((gradient / self.lengths)[self.row][self.order], self.first)
        return out


class Model:
    """Embeddings of features, outputs and biases of the subjects."""

    def __init__(self, vocabulary: list[str], subjects: list[str], seed: int = 7) -> None:
        lists = [features(w) for w in vocabulary]
        used, index = np.unique(np.concatenate([np.array(x) for x in lists]), return_inverse=True)
        self.vocabulary, self.subjects = vocabulary, subjects
        self.used, self.groups, self.plain = used, [], []
        self.parts = (index, np.array([len(x) for x in lists]), len(used))
        rng = np.random.default_rng(seed)
        self.values = [rng.normal(0, 0.1, (len(used), DIMENSIONS)), rng.normal(0, 0.3, (len(subjects), DIMENSIONS)), np.full(len(subjects), -2.0)]

    def word_vectors(self, values: list[np.ndarray]) -> tuple[Ragged, np.ndarray]:
        words = Ragged(*self.parts)
        return words, words.mean(values[0])

    def contributions(self) -> np.ndarray:
        """What each word adds to each subject's logit before averaging."""
        return self.word_vectors(self.values)[1] @ self.values[1].T

    def group_contributions(self) -> dict[str, np.ndarray]:
        """What each telling letter group adds to each subject's logit."""
        rows = np.searchsorted(self.used, [bucket(g) for g in self.groups]).astype(np.int64)
        return dict(zip(self.groups, self.values[0][rows] @ self.values[1].T))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gradient(batches: Iterator[pa.RecordBatch], model: Model, values: list[np.ndarray], frozen: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Gradient of the logistic loss over a task's sentences (words, labels, weight)."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows).combine_chunks()
    words, labels, weight = (table.column(i).combine_chunks() for i in range(3))
    if isinstance(words, pa.ChunkedArray):
        words, labels, weight = words.chunk(0), labels.chunk(0), weight.chunk(0)
    lengths = np.diff(words.offsets.to_numpy())
    sent = Ragged(words.flatten().to_numpy(zero_copy_only=False), lengths, len(model.vocabulary))
    k = len(model.subjects)
    target = np.zeros((len(lengths), k))
    target[np.repeat(np.arange(len(lengths)), np.diff(labels.offsets.to_numpy())), labels.flatten().to_numpy(zero_copy_only=False)] = 1.0
    w = weight.to_numpy(zero_copy_only=False)[:, None].astype(np.float64)
    if frozen is not None:
        own = sent.mean(model.word_vectors(frozen)[1]) @ frozen[1].T + frozen[2]
        target *= _sigmoid(own) > 0.3
    by_word, vectors = model.word_vectors(values)
    hidden = sent.mean(vectors)
    error = (_sigmoid(hidden @ values[1].T + values[2]) - target) * w
    gradients = [by_word.back(sent.back(error @ values[1])), error.T @ hidden, error.sum(axis=0)]
    flat = np.concatenate([g.ravel() for g in gradients]).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([float(w.sum())])], names=["gradient", "weight"])


def fit(train: DataFrame, model: Model, steps: int = STEPS, rate: float = 0.15, decay: float = 0.1) -> Model:
    """Synchronised full-batch training (Adam) on ``words ARRAY<INT>, labels ARRAY<INT>, weight``."""
    spark = train.sparkSession
    first, second = [0.0] * 3, [0.0] * 3
    values, frozen = model.values, None
    shapes = [v.shape for v in values]
    sizes = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
    for step in range(1, steps + 1):
        if step in (steps // 2, steps * 3 // 4):
            frozen = [v.copy() for v in values]
        sent = spark.sparkContext.broadcast((model, values, frozen))
        parts = train.mapInArrow(lambda bs, sent=sent: _gradient(bs, *sent.value), "gradient BINARY, weight DOUBLE").collect()
        sent.unpersist()
        total = sum(r["weight"] for r in parts)
        flat = np.sum([np.frombuffer(r["gradient"], np.float32).astype(np.float64) for r in parts], axis=0) / total
        for i in range(3):
            g = flat[sizes[i] : sizes[i + 1]].reshape(shapes[i]) + (decay * values[i] / total if i < 2 else 0)
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.98 * second[i] + 0.02 * g * g
            values[i] = values[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.98**step)) + 1e-9)
    model.values = values
    return model


def _words(batches: Iterator[pa.RecordBatch], with_sentences: dict[str, int] | None, parts: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Distinct words of each labelled document, or those letter groups of them that are ``parts``, or its sentences as ids of chosen words."""
    for batch in bounded(batches):
        ids, labels, words = [], [], []
        for doc, text, subjects in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for s in sentences(text) if with_sentences is not None else [sorted({w for s in sentences(text) for w in s})]:
                chosen = [with_sentences[w] for w in s if w in with_sentences] if with_sentences is not None else s if parts is None else sorted({g for w in s for g in groups(w) if g in parts})
                if chosen:
                    ids.append(doc)
                    labels.append(subjects)
                    words.append(chosen)
        kind = pa.string() if with_sentences is None else pa.int32()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.list_(pa.int32())), pa.array(words, pa.list_(kind))], names=["doc_id", "labels", "words"])


def telling_words(seen: DataFrame, n_documents: int, prior: dict[int, int], least: int = 3, z: float = 4.5, purity: float = 0.7) -> list[str]:
    """Words that stand with one subject far more often than chance: ``z`` standard deviations, in ``purity`` of their documents.

    All other words (names, phrases of the trade, numbers) tell nothing about a
    subject and would only be learned by heart.
    """
    each = seen.select("doc_id", "labels", F.explode("words").alias("word"))
    total = each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    by = each.select("word", F.explode("labels").alias("label")).groupBy("word", "label").agg(F.count(F.lit(1)).alias("c"))
    rate = F.create_map(*[F.lit(x) for k, v in prior.items() for x in (k, v / n_documents)])[F.col("label")]
    score = (F.col("c") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1e-12)
    chosen = total.join(by, "word").where((score >= z) & (F.col("c") >= purity * F.col("n"))).select("word").distinct()
    return sorted(r["word"] for r in chosen.collect())


def train(documents: DataFrame, labels: DataFrame, areas: DataFrame, most_labelled: int = MOST_LABELLED, steps: int = STEPS) -> Model | None:
    """Model fitted on at most ``most_labelled`` labelled documents; None if no label or no telling word is there."""
    spark = documents.sparkSession
    ship_package(spark)
    subjects = sorted(r["subject"] for r in areas.select("subject").where("subject is not null").distinct().collect())
    if not subjects:
        return None
    number = F.create_map(*[F.lit(x) for i, s in enumerate(subjects) for x in (s, i)])[F.col("subject")]
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), number.cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    bounded = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    # The limit bounds the labels to a few hundred bytes a row, so no text is shuffled to meet them.
    texts = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(bounded), "doc_id"), "labelled")
    counted = {r["label"]: r["n"] for r in texts.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = texts.count()
    if not counted:
        discard(texts)
        return None
    shape = "doc_id BIGINT, labels ARRAY<INT>, words ARRAY<{}>"
    seen = texts.mapInArrow(lambda bs: _words(bs, None), shape.format("STRING"))
    vocabulary = telling_words(seen, n, counted)
    if not vocabulary:
        discard(texts)
        return None
    known = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})
    sents = texts.mapInArrow(lambda bs: _words(bs, known.value), shape.format("INT"))
    # Equal sentences under equal labels are one row with a weight.
    distinct = sents.groupBy("words", "labels").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    gathered = materialize(distinct.select("words", "labels", "weight"), "sentences")
    parts = min(MOST_TASKS, max(1, -(-gathered.count() // TASK_SENTENCES)))
    data = materialize(gathered.repartition(parts), "sentences")
    model = fit(data, Model(vocabulary, subjects), steps)
    parts_ = spark.sparkContext.broadcast(frozenset(g for w in vocabulary for g in groups(w)))
    model.groups = telling_words(texts.mapInArrow(lambda bs: _words(bs, None, parts_.value), shape.format("STRING")), n, counted)
    # Words that the labelled documents show to tell nothing, whatever letters they share.
    often = seen.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    model.plain = sorted({r["word"] for r in often.select("word").collect()} - set(vocabulary))
    discard(texts, gathered, data)
    return model


def _score(batches: Iterator[pa.RecordBatch], index: dict[str, int], adds: np.ndarray, bias: np.ndarray, subjects: list[str], parts: dict[str, np.ndarray], plain: frozenset[str]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[int | str, ...], tuple[int, ...]] = {}
    spelled: dict[str, np.ndarray | None] = {}

    def by_groups(w: str) -> np.ndarray | None:
        """Mean of a word's telling letter groups; None if it has none or is known to tell nothing."""
        if w not in spelled:
            own = [parts[g] for g in groups(w) if g in parts] if w not in plain else []
            spelled[w] = np.mean(own, axis=0) if own else None
        return spelled[w]

    for batch in bounded(batches):
        docs, names, counts, totals = [], [], [], []
        if len(known) > 500_000:
            known.clear()
        if len(spelled) > 500_000:
            spelled.clear()
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = sentences(text)
            hits = [0] * len(subjects)
            for s in found:
                key = tuple([index.get(w, w) for w in s if w in index or by_groups(w) is not None])
                if key:
                    which = known.get(key)
                    if which is None:
                        which = known[key] = tuple(np.flatnonzero(np.mean([by_groups(w) if isinstance(w, str) else adds[w] for w in key], axis=0) + bias > 0).tolist())
                    for k in which:
                        hits[k] += 1
            for k, n in enumerate(hits):
                if n:
                    docs.append(doc)
                    names.append(subjects[k])
                    counts.append(n)
                    totals.append(len(found))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(names, pa.string()), pa.array(counts, pa.int32()), pa.array(totals, pa.int32())], names=["doc_id", "subject", "n_sentences", "n_all"])


SCORED = "doc_id BIGINT, subject STRING, n_sentences INT, n_all INT"


def sentence_counts(documents: DataFrame, labels: DataFrame, areas: DataFrame, **options: int) -> DataFrame:
    """``doc_id, subject, n_sentences, n_all``: sentences of each document that deal with a subject.

    Null and empty texts and null ids give no row; texts of any length are read
    whole. Labels of unknown subjects or documents are ignored, as are repeated
    rows and extra columns; without usable labels the result is empty.
    """
    spark = documents.sparkSession
    model = train(documents, labels, areas, **options)
    if model is None:
        return spark.createDataFrame([], SCORED)
    sent = spark.sparkContext.broadcast(({w: i for i, w in enumerate(model.vocabulary)}, model.contributions(), model.values[2], model.subjects, model.group_contributions(), frozenset(model.plain)))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and length(text) > 0").mapInArrow(lambda bs: _score(bs, *sent.value), SCORED)


def document_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, share: int = SHARE, **options: int) -> DataFrame:
    """``doc_id, subject`` of subjects that at least one in ``share`` sentences of a document deals with."""
    return sentence_counts(documents, labels, areas, **options).where(F.col("n_sentences") * share >= F.col("n_all")).select("doc_id", "subject").distinct()
