"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Two words that differ by one replaced letter have letter counts at squared
distance two; by one inserted or deleted letter, at distance one.  Words are put
into blocks by length and by how many of their letters fall into each of a few
letter classes.  One edit changes the length by at most one and a class count by
at most one, so a block need only meet itself and its neighbours: the blocks
with one more letter, or with one letter moved to a later class.  Each task
multiplies the letter counts of one block with those of its neighbours, keeps
the pairs at most two apart, and verifies the edit letter by letter.

No pair leaves a task: a word's near words are counted and its most frequent one
is kept there, and these figures are merged by word.  Blocks are cut into parts
of ``PART`` words or ``PART_LETTERS`` letters, so a task holds one part and
streams the neighbours past it.  More letter classes for larger vocabularies
keep blocks small; any classes give the same pairs.

Defined results: null and empty texts have no words; a null doc_id reads
``null`` in the hash.  Rows repeating doc_id and text count anew.  Words of any
length take part.  Among near words of equal count the first by code point is
the form.  Counts rise at least tenfold from word to form, so roots are found in
as many joins as the logarithm of that chain.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.llm.base import documents, landed, register
from insight.llm.words import LOWER, flat, ragged, spans, text_slices
from insight.operators.joins import join_dimension

#: least code points and occurrences of a word, and how much more frequent its form is
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: one run in so many, by hash of document and run, loses a code point
ONE_IN = 31
#: words and letters in one part of a block
PART, PART_LETTERS = 1024, 1 << 20
#: words of neighbouring blocks multiplied at once
CHUNK = 4096
#: a-z and U+00C0 to U+00FF, one byte each in Latin-1
LETTERS = 26 + 64

def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ np.where(value & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return value


_CRC = _crc_table()


# --- words of the texts

def hashed(buf: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each span continued from ``state`` (crc32 of what comes before it), all spans byte by byte at once."""
    out = ~state
    by = np.argsort(-size, kind="stable")
    at, length, value = start[by], size[by], out[by]
    deep = int(np.searchsorted(-length, -64, "right"))  # beyond 64 bytes one by one
    for i in range(deep):
        span = buf[at[i]:at[i] + length[i]].tobytes()
        value[i] = ~np.uint32(zlib.crc32(span, int(~value[i])))
    for k in range(int(length[deep]) if deep < len(by) else 0):
        n = int(np.searchsorted(-length, -k, "left"))  # spans longer than k
        v = value[deep:n]
        value[deep:n] = _CRC[(v ^ buf[at[deep:n] + k]) & np.uint32(255)] ^ (v >> np.uint32(8))
    out[by] = value
    return ~out


def words_of(batch: pa.RecordBatch, one_in: int = ONE_IN, least: int = LEAST_LENGTH) -> pa.Array:
    """The words of a slice of documents (doc_id, text): letter runs in lower case, one in so many short of a code point."""
    buf, offsets = flat(batch.column("text"))
    if len(buf) == 0:
        return pa.array([], pa.string())
    low = LOWER[buf]
    lead = buf == 0xC3  # U+00C0 to U+00FF are this byte and one more
    letter = ((low >= 97) & (low <= 122)) | lead
    letter[1:] |= lead[:-1]
    outside = np.ones(256, bool)
    outside[1] = False
    w = spans(letter.view(np.uint8), offsets, outside)
    before = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    size = (w.end - w.start) - (before[w.end] - before[w.start])  # code points
    long = np.flatnonzero(size >= least)
    start, end, size, row = w.start[long], w.end[long], size[long], w.row[long]
    prefix = np.array([zlib.crc32(f"{'null' if i is None else i}:".encode()) for i in batch.column("doc_id").to_pylist()], np.uint32)
    h = hashed(low, start, end - start, prefix[row]).astype(np.int64)
    hit = np.flatnonzero(h % one_in == 0)
    inside = ragged(start, end - start)
    kept = np.ones(len(inside), bool)
    if len(hit):
        first = (buf & 0xC0) != 0x80
        index = np.cumsum(first, dtype=np.int64) - 1
        gone = np.flatnonzero(first)[index[start[hit]] + h[hit] % size[hit]]
        at = np.concatenate([[0], np.cumsum(end - start)[:-1]])[hit] + gone - start[hit]
        kept[at] = False
        kept[at[lead[gone]] + 1] = False
    heads = np.concatenate([[0], np.cumsum(end - start)[:-1]]) if len(start) else np.zeros(0, np.int64)
    length = np.add.reduceat(kept, heads, dtype=np.int64) if len(start) else heads
    cut = size.copy()
    cut[hit] -= 1
    data = low[inside[kept]]
    ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    return found.filter(pa.array(cut >= least))


def _counted(one_in: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                counts = pc.value_counts(words_of(part, one_in, least))
                yield pa.record_batch([counts.field(0).cast(pa.string()), counts.field(1).cast(pa.int64())], names=["word", "n"])

    return run


def vocabulary(docs: DataFrame, one_in: int = ONE_IN, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): distinct words of at least ``least`` code points that occur ``least_count`` times or more."""
    return docs.select("doc_id", "text").mapInArrow(_counted(one_in, least), "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- blocks

def latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters 0 to 89 of all words, flat; number of letters of each)."""
    buf, offsets = flat(words)
    lead = buf == 0xC3
    value = buf.astype(np.int16) - 97
    value[1:][lead[:-1]] += 97 - 0x80 + 26
    before = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    return value[~lead], np.diff(offsets - before[offsets])


def _letter_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS, np.int64)
    for batch in batches:
        total += np.bincount(latin(batch.column("word"))[0], minlength=LETTERS)
    yield pa.record_batch([pa.array(np.arange(LETTERS)), pa.array(total)], names=["letter", "n"])


def letter_classes(words: DataFrame, classes: int) -> np.ndarray:
    """Class of each letter: the most frequent letters dealt to the lightest class each."""
    rows = words.select("word").mapInArrow(_letter_totals, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    weight, of = np.zeros(classes, np.int64), np.zeros(LETTERS, np.int64)
    for r in sorted(rows, key=lambda r: (-r.n, r.letter)):
        of[r.letter] = np.argmin(weight)
        weight[of[r.letter]] += r.n
    return of


def _name(counts) -> str:
    return ",".join(map(str, counts))


def neighbours(key: str) -> list[str]:
    """Blocks that this one is sent to: one letter fewer, or one letter of a class in an earlier class instead."""
    counts = list(map(int, key.split(",")))
    out = []
    for i, c in enumerate(counts):
        if c:
            fewer = [*counts[:i], c - 1, *counts[i + 1:]]
            out.append(_name(fewer))
            for j in range(i):
                out.append(_name([*fewer[:j], fewer[j] + 1, *fewer[j + 1:]]))
    return out


def _keyed(of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = int(of.max()) + 1
        for batch in batches:
            if batch.num_rows == 0:
                continue
            letters, size = latin(batch.column("word"))
            row = np.repeat(np.arange(len(size)), size)
            counts = np.bincount(row * classes + of[letters], minlength=len(size) * classes).reshape(-1, classes)
            distinct, at = np.unique(counts, axis=0, return_inverse=True)
            keys = pa.array([_name(c) for c in distinct.tolist()], pa.string())
            yield pa.record_batch([keys.take(pa.array(at.ravel())), batch.column("word"), batch.column("n"), pa.array(size)],
                                  names=["key", "word", "n", "letters"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal (key, part): its words and counts, and the blocks that it is sent to."""
    def rows(t: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(cuts, pa.int32())
        keys = t.column("key").take(pa.array(cuts[:-1]))
        part = t.column("part").take(pa.array(cuts[:-1]))
        return pa.record_batch([keys, part, pa.ListArray.from_arrays(offsets, t.column("word")),
                                pa.ListArray.from_arrays(offsets, t.column("n")),
                                pa.array([neighbours(k) for k in keys.to_pylist()], pa.list_(pa.string()))],
                               names=["key", "part", "words", "counts", "targets"])

    open_ = None
    for batch in batches:
        t = batch if open_ is None else pa.concat_batches([open_, batch])
        if t.num_rows == 0:
            continue
        key = t.column("key").dictionary_encode().indices.to_numpy()
        part = t.column("part").to_numpy()
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
        if len(new):
            done = t.slice(0, int(new[-1]))
            yield rows(done, np.concatenate([[0], new]))
            t = t.slice(int(new[-1]))
        open_ = t
    if open_ is not None and open_.num_rows:
        yield rows(open_, np.array([0, open_.num_rows]))


def blocks(words: DataFrame, classes: int) -> DataFrame:
    """key, part, words, counts, targets: the vocabulary in parts of blocks."""
    keyed = landed(words.select("word", "n").mapInArrow(_keyed(letter_classes(words, classes)),
                                                        "key string, word string, n long, letters long"), "spelling-keys")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / PART, F.sum("letters") / PART_LETTERS)).cast("int")
    large = landed(keyed.groupBy(F.col("key").alias("large")).agg(parts.alias("parts")).filter("parts > 1"), "spelling-sizes")
    dealt = join_dimension(keyed, large, F.col("key") == F.col("large"), "left") \
        .withColumn("part", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = dealt.select("key", "part", "word", "n").repartition(tasks, "key", "part").sortWithinPartitions("key", "part") \
        .mapInArrow(_packed, "key string, part int, words array<string>, counts array<long>, targets array<string>")
    return landed(packed, "spelling-blocks")


# --- near pairs

class Part:
    """Words of one length with their counts, as rows of letters."""

    def __init__(self, words: pa.Array, counts: np.ndarray):
        letters, size = latin(words)
        self.words, self.counts, self.length = words, counts, int(size[0])
        self.letters = letters.reshape(len(words), -1)

    def histogram(self, dtype) -> np.ndarray:
        n = len(self.words)
        flat_ = (np.arange(n)[:, None] * LETTERS + self.letters).ravel()
        return np.bincount(flat_, minlength=n * LETTERS).reshape(n, LETTERS).astype(dtype)


def close_counts(a: Part, b: Part) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose letter counts are at squared distance 1 or 2, by one matrix product."""
    dtype = np.float32 if max(a.length, b.length) < 2000 else np.float64  # all terms stay exact
    x, y = a.histogram(dtype), b.histogram(dtype)
    used = np.flatnonzero(x.any(axis=0) | y.any(axis=0))
    x, y = x[:, used], y[:, used]
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    left = np.concatenate([x, xx[:, None], np.ones((len(x), 1), dtype)], axis=1)
    right = np.concatenate([-2 * y, np.ones((len(y), 1), dtype), yy[:, None]], axis=1)
    distance = left @ right.T
    at = np.flatnonzero(distance.ravel() < 2.5)
    at = at[distance.ravel()[at] > 0.5]
    return at // len(y), at % len(y)


def one_edit(a: Part, b: Part, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs differ by exactly one edit; b's words are as long as a's or one letter longer."""
    out = np.zeros(len(i), bool)
    step = max(1, (1 << 22) // (b.length + 1))
    for s in range(0, len(i), step):
        x, y = a.letters[i[s:s + step]], b.letters[j[s:s + step]]
        if a.length == b.length:
            out[s:s + step] = (x != y).sum(axis=1) == 1
        else:
            head = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
            tail = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            out[s:s + step] = head + tail >= a.length
    return out


def best(mine: Part, other: Part, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """For each word of ``mine`` in the pairs: how many there are, and the most frequent other word, first by code point."""
    # fixed-width byte strings sort as the words do (letters shifted off zero)
    as_bytes = np.ascontiguousarray((other.letters + 1).astype(np.uint8)).view(f"S{other.length}").ravel()
    order = np.empty(len(as_bytes), np.int64)
    order[np.argsort(as_bytes, kind="stable")] = np.arange(len(as_bytes))
    by = np.lexsort((order[j], -other.counts[j], i))
    i, j = i[by], j[by]
    first = np.flatnonzero(np.concatenate([[True], np.diff(i) != 0])) if len(i) else np.zeros(0, np.int64)
    return pa.record_batch([mine.words.take(pa.array(i[first])), pa.array(np.diff(np.append(first, len(i)))),
                            pa.array(other.counts[j[first]]), other.words.take(pa.array(j[first]))],
                           names=["word", "near", "top_n", "top"])


_NEAR = "word string, near long, top_n long, top string"


def _met(a: Part, others: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    words = pa.concat_arrays([w for w, _ in others])
    counts = np.concatenate([n for _, n in others])
    for s in range(0, len(words), CHUNK):
        b = Part(words.slice(s, CHUNK), counts[s:s + CHUNK])
        i, j = close_counts(a, b)
        ok = one_edit(a, b, i, j)
        if ok.any():
            yield best(a, b, i[ok], j[ok])
            yield best(b, a, j[ok], i[ok])


def _within(a: Part) -> Iterator[pa.RecordBatch]:
    i, j = close_counts(a, a)
    ok = one_edit(a, a, i, j)
    if ok.any():
        yield best(a, a, i[ok], j[ok])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, part, side): the part itself (side 0), then all that it meets (side 1)."""
    own, at, waiting = None, None, {}  # waiting: by length of the words
    for batch in batches:
        places = zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True)
        sides = batch.column("side").to_pylist()
        for r, place in enumerate(places):
            words, counts = (batch.column(c).slice(r, 1).flatten() for c in ("words", "counts"))
            if place != at:
                for others in waiting.values():
                    yield from _met(own, others)
                own, at, waiting = None, place, {}
            if sides[r] == 0:
                own = Part(words, counts.to_numpy())
                yield from _within(own)
            elif own is not None:  # a part may have got no words
                size = len(words[0].as_py())
                others = waiting.setdefault(size, [])
                others.append((words, counts.to_numpy()))
                if sum(len(w) for w, _ in others) >= CHUNK:
                    yield from _met(own, waiting.pop(size))
    for others in waiting.values():
        yield from _met(own, others)


def near_words(words: DataFrame, classes: int | None = None) -> DataFrame:
    """(word, n_near, top_n, top) of words that have a near word."""
    if classes is None:  # blocks of some hundred words, whatever their number
        classes = min(24, max(4, round(np.log2(words.count() + 1) / 3.4)))
    packed = blocks(words, classes)
    sizes = landed(packed.groupBy(F.col("key").alias("target")).agg((F.max("part") + 1).alias("parts")), "spelling-targets")
    own = packed.select("key", "part", F.lit(0).alias("side"), "words", "counts")
    sent = packed.select(F.col("key").alias("from"), F.col("part").alias("index"), "words", "counts",
                         F.explode(F.array_append("targets", F.col("key"))).alias("key"))
    # a part of the same block is met by the parts before it
    met = join_dimension(sent, sizes, F.col("key") == F.col("target")) \
        .withColumn("last", F.when(F.col("from") == F.col("key"), F.col("index")).otherwise(F.col("parts"))) \
        .filter("last > 0").select(F.explode(F.sequence(F.lit(0), (F.col("last") - 1).cast("int"))).alias("part"),
                                   "key", "words", "counts")
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = own.unionByName(met.select("key", "part", F.lit(1).alias("side"), "words", "counts"))
    pairs = both.repartition(tasks, "key", "part").sortWithinPartitions("key", "part", "side").mapInArrow(_near, _NEAR)
    top = F.min(F.struct((-F.col("top_n")).alias("minus"), "top"))
    return pairs.groupBy("word").agg(F.sum("near").alias("n_near"), top.alias("best")) \
        .select("word", "n_near", (-F.col("best.minus")).alias("top_n"), F.col("best.top").alias("top"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the chain of forms, by doubling."""
    now = landed(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = landed(now.join(further, F.col("root") == F.col("at"), "left")
                      .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, one_in: int = ONE_IN, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             times: int = TIMES, classes: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text)."""
    words = landed(vocabulary(docs, one_in, least, least_count), "spelling-words")
    near = near_words(words, classes).withColumnRenamed("word", "of")
    enough = F.col("top_n") >= F.col("n") * times
    rows = landed(words.join(near, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("top")).alias("form"),
        F.when(enough, F.col("top_n")).alias("form_n")), "spelling-forms")
    ends = roots(rows.filter("form IS NOT NULL")).select(F.col("word").alias("of"), F.col("root").alias("end"))
    return rows.join(ends, F.col("word") == F.col("of"), "left") \
        .select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


@register("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
