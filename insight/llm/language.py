"""Language identification by prediction by partial matching over bytes.

Every language has a context tree: how often each byte followed each context of
up to ``ORDER`` bytes.  A byte that its longest known context has not seen
escapes to the next shorter one, where the bytes of the longer context are
excluded; below order 0 the remaining bytes are equally likely.  With escape
method C (as many escapes as distinct bytes) the predictions of any context sum
to 1, so the sum of ``-log2 p`` is the exact length of the text under the
language's frozen statistics.  The prediction is the language with the largest
probability of the text, times the language's share of the learned documents.

As counts never change while scoring, the cost of a byte depends on the byte and
the ``ORDER`` bytes before it only: each piece of text is reduced to its
distinct grams, each gram is priced once a language, and prices are summed.

The trees are learned from a bounded sample (``SAMPLE`` documents a language, of
at most ``LONGEST`` characters, by a hash of doc_id), counted in Spark; the
shares from all documents to learn from.  Every text is scored whole, in one
pass without a shuffle, in pieces of ``PIECE`` bytes, so memory does not follow
the length of a text.

Defined results: a text that is null, empty or without a letter is ``und`` with
score 0, and so is every text when nothing could be learned.  Texts are preceded
by ``ORDER`` line ends, A-Z are read as a-z, and a run of other ASCII characters
as one blank, so that digits and marks do not weigh.  Of equally probable
languages the first by code point is taken.  Null languages and null texts are not learned
from; a document without doc_id is learned from and not held out.  Rows
repeating a doc_id are scored one by one.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from insight.llm.base import documents, register
from insight.llm.words import flat, text_slices
from insight.operators.joins import join_dimension

#: bytes of context, at most (a gram of 7 bytes and less fits a long)
ORDER = 4
#: most documents a language that the trees are learned from, and most characters of each
SAMPLE, LONGEST = 400, 20_000
#: bytes priced at once
PIECE = 1 << 21


#: a-z and all bytes beyond ASCII stay
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def padded(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(folded bytes with ``order`` line ends before each text, where each text begins in them and the end)."""
    buf, offsets = flat(column)
    buf = FOLD[buf]
    kept = np.ones(len(buf), bool)
    kept[1:] = (buf[1:] != 32) | (buf[:-1] != 32)
    kept[offsets[:-1][offsets[:-1] < len(buf)]] = True
    buf, offsets = buf[kept], np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[offsets]
    out = np.full(len(buf) + order * len(column), 10, np.uint8)
    starts = offsets + order * np.arange(1, len(offsets) + 1)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    out[np.arange(len(buf)) + order * (row + 1)] = buf
    return out, starts


def pieces(column: pa.Array, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, row) of every byte, ``PIECE`` bytes at a time."""
    data, starts = padded(column, order)
    row = 0
    for a in range(order, len(data), PIECE):
        b = min(a + PIECE, len(data))
        gram = np.zeros(b - a, np.int64)
        for back in range(order, -1, -1):
            gram = (gram << 8) | data[a - back:b - back]
        at = np.arange(a, b)
        row = np.searchsorted(starts, at, "right") - 1
        own = (row >= 0) & (row < len(column)) & (at < starts[np.minimum(row + 1, len(column))] - order)
        yield gram[own], row[own]


@dataclass
class Tree:
    """Frozen statistics of one language: by context length, sorted (context, byte) keys with counts, and contexts with
    the sum of counts, the number of distinct bytes, and the sum of those bytes' counts one order lower."""

    leaf: list[np.ndarray]
    count: list[np.ndarray]
    node: list[np.ndarray]
    total: list[np.ndarray]
    distinct: list[np.ndarray]
    shared: list[np.ndarray]

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray, order: int) -> Tree:
        leaf, count, node, total, distinct, shared = [], [], [], [], [], []
        for j in range(order + 1):
            keys, at = np.unique(grams & ((1 << 8 * (j + 1)) - 1), return_inverse=True)
            c = np.bincount(at, counts, len(keys)).astype(np.int64)
            nodes, first = np.unique(keys >> 8, return_index=True)
            leaf.append(keys)
            count.append(c)
            node.append(nodes)
            total.append(np.add.reduceat(c, first) if len(first) else c)
            distinct.append(np.diff(np.append(first, len(keys))))
            if j:
                lower = count[j - 1][np.searchsorted(leaf[j - 1], keys & ((1 << 8 * j) - 1))]
                shared.append(np.add.reduceat(lower, first) if len(first) else lower)
            else:
                shared.append(np.zeros(len(nodes), np.int64))
        return cls(leaf, count, node, total, distinct, shared)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the bytes before it."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        taken = np.zeros(len(grams), np.int64)  # counts of excluded bytes in the next lower context
        known = np.zeros(len(grams), np.int64)  # how many bytes are excluded
        for j in range(len(self.leaf) - 1, -1, -1):
            if not len(self.node[j]):
                continue
            g = grams[left]
            context = (g >> 8) & ((1 << 8 * j) - 1)
            at = np.minimum(np.searchsorted(self.node[j], context), len(self.node[j]) - 1)
            there = self.node[j][at] == context
            new = np.where(there, self.distinct[j][at] - known[left], 0)
            whole = self.total[j][at] - taken[left] + new
            key = g & ((1 << 8 * (j + 1)) - 1)
            spot = np.minimum(np.searchsorted(self.leaf[j], key), len(self.leaf[j]) - 1)
            hit = (new > 0) & (self.leaf[j][spot] == key)
            escape = (new > 0) & ~hit
            out[left[hit]] += np.log2(whole[hit] / self.count[j][spot[hit]])
            out[left[escape]] += np.log2(whole[escape] / new[escape])
            taken[left[there]] = self.shared[j][at[there]]
            known[left[there]] = self.distinct[j][at[there]]
            left = left[~hit]
        out[left] += np.log2(np.maximum(256 - known[left], 1))
        return out


@dataclass
class Model:
    names: list[str]
    trees: list[Tree]
    prior: np.ndarray  # log2 of each language's share of the documents learned from
    order: int

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Code length of each text (rows) under each language (columns)."""
        out = np.zeros((len(column), len(self.names)))
        for gram, row in pieces(column, self.order):
            code, distinct = pd.factorize(gram)
            by = np.argsort(distinct)  # sorted keys keep the searches in cache
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            code = place[code]
            for k, tree in enumerate(self.trees):
                out[:, k] += np.bincount(row, tree.bits(distinct[by])[code], len(column))
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the most probable language, its probability)."""
        z = self.prior - self.lengths(column)
        best = np.argmax(z, axis=1)
        gap = z - z[np.arange(len(z)), best][:, None]
        return best, 1 / np.exp2(np.maximum(gap, -1000)).sum(axis=1)


def counted(order: int):
    """(lang, gram, n) of a batch of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for name in sorted(set(names)):
                texts = batch.filter(pa.array([n == name for n in names])).column("text")
                for gram, _ in pieces(texts, order):
                    keys, n = np.unique(gram, return_counts=True)
                    yield pa.record_batch([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))],
                                          names=["lang", "gram", "n"])

    return run


def learn(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, order: int = ORDER) -> Model:
    """Trees of a bounded sample of ``docs`` (doc_id, text, lang) and shares of all of them."""
    docs = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    ids = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("draw"))
    share = ids.groupBy("lang").count()
    rows = share.orderBy("lang").collect()
    # an even cut by hash first, so that no language is ordered whole; then the exact bound
    room = F.least(F.lit(2.0 * sample) / F.col("size"), F.lit(1.0))
    sizes = share.select(F.col("lang").alias("of"), F.col("count").alias("size"))
    short = docs.filter(F.char_length("text") <= longest).withColumn("draw", F.xxhash64("doc_id"))
    cut = join_dimension(short, sizes, F.col("lang") == F.col("of")) \
        .filter(F.shiftrightunsigned(F.col("draw"), 11) / F.lit(float(1 << 53)) <= room)
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    drawn = cut.select("lang", "doc_id", "draw", "text").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= sample)
    table = drawn.select("lang", "text").mapInArrow(counted(order), "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang = table.column("lang").to_numpy()
    gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    names = sorted(set(lang))  # a language of only long texts has no tree
    trees = [Tree.of(gram[lang == x], n[lang == x], order) for x in names]
    counts = {r["lang"]: r["count"] for r in rows}
    prior = np.log2(np.array([counts[x] for x in names], float) / sum(counts.values())) if names else np.zeros(0)
    return Model(names, trees, prior, order)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text)."""
    texts = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not model.names:
        return texts.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array([*model.names, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                best, score = shared.value.predict(part.column("text"))
                some = part.column("letters").to_numpy(zero_copy_only=False)
                yield pa.record_batch([part.column("doc_id"), pa.array(names[np.where(some, best, len(names) - 1)], pa.string()),
                                       pa.array(np.where(some, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@register("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    rows = predicted(docs, learn(docs.filter(~held_out())))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
