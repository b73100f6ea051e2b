"""Toxicity by multiple-instance learning: sentences are instances, documents are labelled.

A sentence's score is a logistic function of the fingerprints of its words and
word beginnings; a document's is the noisy-or of its sentences, ``1 - prod(1 - p)``.
Where texts are scored, what a sentence has above ``LEAST`` counts: sentences
below it, with or without known features, add nothing in any number, so no text
is toxic by its length.  Only document labels are known, so the gradient of the
document likelihood is shared out among its sentences: each takes part as far as
it is thought to be the reason.  The weights then locate the offending
sentences.

The model is fitted on a bounded sample of labelled rows (``sample`` documents
of each class, drawn by a hash of doc_id) in numpy on the driver; every text is
scored whole, in one pass without a shuffle.

Defined results: null, empty and wordless texts have no sentence and score 0.
An empty table gives no rows.  Texts of any length are scored whole; a longer
one than ``words.CHUNK`` is handled alone.  A score of exactly 0.5 is toxic.
Several labels of one doc_id count as toxic if one says so; null labels and
labels without document are not learned from.  Without any toxic (or any clean)
label the model has no weights and scores 0.  Rows repeating a doc_id are
scored one by one; other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.llm.base import DOCUMENT, documents, register
from insight.llm.words import LOWER, Words, fingerprints, flat, mix, spans, text_slices

#: most labelled documents learned from, of each class
SAMPLE = 2000
#: probability up to which a sentence adds nothing to its text's
LEAST = 0.05
#: a word gives its own fingerprint and those of its first bytes
BEGINNINGS = (None, 4, 5, 6)
_SALTS = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.uint64)

#: bytes that end a word: ASCII other than letters, digits and the apostrophe
WORD_BREAK = np.ones(256, bool)
WORD_BREAK[[*range(48, 58), *range(97, 123), 39, *range(128, 256)]] = False
SENTENCE_BREAK = np.zeros(256, bool)
SENTENCE_BREAK[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Instances:
    """Sentences of a slice of texts: their features, flat, and the byte spans they cover."""

    row: np.ndarray  # of each sentence
    feature: np.ndarray  # uint32, len(BEGINNINGS) for each word
    sentence: np.ndarray  # of each feature
    start: np.ndarray  # byte offset of the sentence's first word within the slice
    end: np.ndarray


def instances(column: pa.Array) -> Instances:
    buf, offsets = flat(column)
    low = LOWER[buf]
    w: Words = spans(low, offsets, WORD_BREAK)
    if len(w.start) == 0:
        none = np.zeros(0, np.int64)
        return Instances(none, np.zeros(0, np.uint32), none, none, none)
    row = w.row
    mark = np.cumsum(SENTENCE_BREAK[low])[w.start]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(mark) != 0)
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1
    kinds = [(mix(fingerprints(w, size) ^ salt) >> np.uint64(32)).astype(np.uint32)
             for size, salt in zip(BEGINNINGS, _SALTS, strict=False)]
    return Instances(row[first].astype(np.int64), np.concatenate(kinds), np.tile(sentence, len(kinds)),
                     w.start[first], w.end[last])


@dataclass
class Model:
    """Sorted feature fingerprints with their weights, and the bias of a sentence."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def __post_init__(self):
        self.known = np.zeros(1 << 20, bool)  # by the low bits: most words miss here already
        self.known[self.feature & np.uint32((1 << 20) - 1)] = True

    def sentence_scores(self, x: Instances) -> np.ndarray:
        """p of each sentence, as far as it is above ``LEAST`` (and above what the bias alone gives)."""
        z = np.full(len(x.row), self.bias)
        if len(self.feature):
            near = np.flatnonzero(self.known[x.feature & np.uint32((1 << 20) - 1)])
            f = x.feature[near]
            at = np.minimum(np.searchsorted(self.feature, f), len(self.feature) - 1)
            hit = self.feature[at] == f
            # a feature counts once in a sentence, however often it is repeated
            found = np.unique(x.sentence[near[hit]] * len(self.feature) + at[hit])
            z += np.bincount(found // len(self.feature), self.weight[found % len(self.feature)], len(z))
        p, alone = (1 / (1 + np.exp(-np.clip(v, -40, 40))) for v in (z, self.bias))
        floor = max(alone, LEAST)
        return np.maximum(p - floor, 0.0) / (1 - floor)


def noisy_or(row: np.ndarray, p: np.ndarray, rows: int) -> np.ndarray:
    """1 - prod(1 - p) over the sentences of each row."""
    return -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), rows))


def fit(labels: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], epochs: int = 20, rate: float = 1.0,
        bias: float = -10.0, shrink: float = 0.02, least: float = 0.1) -> Model:
    """AdaGrad on the noisy-or likelihood, weights drawn towards 0 by ``shrink``.

    ``bags``: (features, sentence of each, no repeats) of each document.  The bias
    keeps a sentence without known features near 0, so that thousands of them do
    not add up.  Weights below ``least`` are left out of the model.  The order of
    the documents fixes the result.
    """
    labels = np.asarray(labels)
    if len(labels) == 0 or not labels.any() or labels.all():
        return Model(np.zeros(0, np.uint32), np.zeros(0), bias)
    vocabulary = np.unique(np.concatenate([np.unique(f) for f, _ in bags]))
    weight, seen = np.zeros(len(vocabulary)), np.full(len(vocabulary), 1e-6)
    # classes count alike, however many documents each has
    share = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    order = np.random.default_rng(11)
    sentences = np.array([int(s[-1]) + 1 if len(s) else 0 for _, s in bags])
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(bags)), max(1, len(bags) // 200)):
            counts = sentences[part]
            base = np.concatenate([[0], np.cumsum(counts)])
            sent = np.concatenate([bags[i][1].astype(np.int64) + b for i, b in zip(part, base, strict=False)])
            f = np.searchsorted(vocabulary, np.concatenate([bags[i][0] for i in part]))
            bag = np.repeat(np.arange(len(part)), counts)
            z = bias + np.bincount(sent, weight[f], base[-1])
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            whole = np.clip(noisy_or(bag, p, len(part)), 1e-9, 1 - 1e-9)
            # a toxic document's gradient goes to its sentences as far as each is the likely reason
            blame = np.where(labels[part] == 1, (1 - whole) / whole, -1.0) * share[part]
            up = np.bincount(f, (blame[bag] * p)[sent], len(weight))
            seen += up * up
            step = rate / np.sqrt(seen)
            weight += step * up
            weight = np.sign(weight) * np.maximum(np.abs(weight) - step * shrink, 0)
    keep = np.abs(weight) >= least
    return Model(vocabulary[keep], weight[keep], bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample`` documents of each class, by a hash of doc_id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")

    def drawn(toxic):
        return known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    # at most 2 * sample rows of two numbers: small by construction
    return docs.select("doc_id", "text").join(F.broadcast(drawn(0).unionByName(drawn(1))), "doc_id")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            x = instances(part.column("text"))
            pairs = np.unique((x.sentence.astype(np.uint64) << np.uint64(32)) | x.feature)
            sentence = (pairs >> np.uint64(32)).astype(np.int64)
            feature = (pairs & np.uint64(2**32 - 1)).astype(np.uint32)
            first = np.searchsorted(x.row, np.arange(part.num_rows + 1))  # sentences of each row
            cut = np.searchsorted(sentence, first)
            feats = [feature[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            sents = [(sentence[a:b] - s).astype(np.uint32).tobytes()
                     for a, b, s in zip(cut[:-1], cut[1:], first[:-1], strict=True)]
            yield pa.record_batch([part.column("doc_id"), part.column("toxic").cast(pa.int32()),
                                   pa.array(feats, pa.binary()), pa.array(sents, pa.binary())],
                                  names=["doc_id", "toxic", "feats", "sents"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = labelled_sample(docs, labels, sample).select("doc_id", "toxic", "text") \
        .mapInArrow(_bags, "doc_id long, toxic int, feats binary, sents binary").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, bytes(r.feats)))
    bags = [(np.frombuffer(r.feats, np.uint32), np.frombuffer(r.sents, np.uint32)) for r in rows]
    return fit(np.array([r.toxic for r in rows]), bags)


def scored(docs: DataFrame, model: Model, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """``columns`` of docs with score, predicted, and the offending sentences (byte spans within the text)."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                x = instances(part.column("text"))
                p = model.sentence_scores(x)
                score = noisy_or(x.row, p, part.num_rows) + 0.0  # no negative zero
                _, offsets = flat(part.column("text"))
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(p >= threshold):
                    r, base = int(x.row[i]), int(offsets[x.row[i]])
                    found[r].append({"start": int(x.start[i]) - base, "end": int(x.end[i]) - base, "score": float(p[i])})
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], pa.array(score),
                     pa.array((score >= threshold).astype(np.int32)),
                     pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                    names=[*columns, "score", "predicted", "offending"])

    kept = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.select(*columns).dtypes)
    return kept.mapInArrow(run, schema + ", score double, predicted int, "
                           "offending array<struct<start: bigint, end: bigint, score: double>>")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def train_split(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return train(docs, labels.filter(~held_out()))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not reject, with the columns of the documents table."""
    return scored(docs, model, DOCUMENT).filter("predicted = 0").select(DOCUMENT)


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = scored(docs, train_split(spark, docs, sf_dir), ["doc_id"])
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "offending")
