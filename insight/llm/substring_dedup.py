"""Substring dedup by seed and extend.

Passages of at least ``size`` words that repeat across documents are removed from
all but the document with the smallest doc_id.

1. Seeds: every window of ``size`` words has as its anchor the first of the
   smallest hashes of the ``ANCHOR``-word runs inside it (winnowing), so equal
   windows have equal anchors at equal places.  Anchors met in texts of two
   classes at least are the seeds.  Each place of a seed is one row: the words that
   its windows reach, and how far to the left the first and the last of them begin.
2. Extension: the rows of a seed meet the group's representative, the row with the
   smallest doc_id, and extend the match to the left and to the right, word by word.
   Windows inside the match start in the representative's document too: repeats.
3. Refinement: what reaches beyond the match on the left goes on with the rows that
   part from the representative at the same place with the same word, likewise on
   the right, under the next representative.  A window goes one way only, so the
   parts of a row never overlap and no pairs are made.
4. Neighbouring repeats are united into maximal ones and cut; windows are judged on
   the texts as they came.

Groups of up to ``limit`` rows are refined inside one task.  Larger ones take a
join with their representatives for each step (the hot group's rows stay spread),
until their parts are small.

Texts with equal word sequences are one class: all but the smallest doc_id of a
class of long enough texts lose every word without a join.  Only texts of a class
new to a task send their places, so copies of any number stay cheap.

Defined results: null, empty and wordless texts and those with fewer than
``size`` words lose nothing; an empty table gives an empty one.  Rows repeating a
doc_id do not remove each other's words; a null doc_id is neither smaller nor
larger than any and loses nothing.  Ties: of equal places the one in the smallest
doc_id stays, wherever else the others are.  Columns other than doc_id and text are
not read, whatever their names.  Texts of any length are handled whole.  Words are
compared place by place by 48 bits of their fingerprints, so a false repeat needs
two different words met at the end of a match (two such meetings a row and step) to
agree in 48 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.llm import filters
from insight.llm.base import documents, landed, register
from insight.llm.words import GRAM, Words, fingerprints, flat, grams, in_row, mix, powers, ragged, split_words, text_slices
from insight.operators.joins import join_dimension

#: words of a repeat at least, and of an anchor
SIZE = 50
ANCHOR = 16
#: rows of a seed that one task refines by itself
LIMIT = 1024
#: bytes of a word's fingerprint that are compared, and rows sent at once
BYTES = 6
PORTION = 10_000
#: a place of a seed: ``at`` is its word in the text, ``words`` begins ``before`` words to its left, and its
#: windows begin ``lo`` to ``hi`` words to its left
PLACE = "key long, doc_id long, cls long, at int, before int, lo int, hi int, words binary"
NOTHING = hashlib.sha256(b"").hexdigest()


def first_min(h: np.ndarray, k: int) -> np.ndarray:
    """Where the minimum of every ``k`` neighbours is, the first of equal ones, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def less(a, b):
        return np.where(h[b] < h[a], b, a)

    at, size = np.arange(len(h)), 1
    while size * 2 <= k:
        at = less(at[:-size], at[size:])
        size *= 2
    return less(at[:n], at[k - size:k - size + n])


def places(w: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(anchor, place, row, lo, hi) of every place that is some window's anchor; place counts words of the slice,
    lo and hi how many words to its left its last and its first window begin."""
    k, n = min(ANCHOR, size), len(h) - size + 1
    starts = np.flatnonzero(in_row(w.first, size, n)) if n > 0 else np.zeros(0, np.int64)
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    runs = grams(h, k)
    place = first_min(runs, size - k + 1)[starts]
    head = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    tail = np.append(head[1:], len(starts)) - 1
    place = place[head]
    return runs[place].view(np.int64), place, w.row[place], place - starts[tail], place - starts[head]


class Fresh:
    """Tells the rows that a task must send: long enough, with a doc_id, and of a class it has not sent under a
    smaller doc_id."""

    def __init__(self, size: int, most: int = 1_000_000):
        self.size, self.most, self.least = size, most, {}

    def __call__(self, ids: pa.Array, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
        send = np.zeros(len(cls), bool)
        for r in np.flatnonzero(np.diff(first) >= self.size).tolist():
            i, c = ids[r].as_py(), int(cls[r])
            if i is not None and i < self.least.get(c, i + 1):
                self.least[c] = i
                send[r] = True
        if len(self.least) > self.most:
            self.least.clear()
        return send


def classes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each row's word sequence."""
    n = np.diff(first)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(first[:-1], n).astype(np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ mix(place * GRAM + GRAM)), dtype=np.uint64)])
    return mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64) * GRAM).view(np.int64)


def _survey(size: int):
    """(doc_id, cls, n, sha256 of the words joined by blanks, anchors) of each row; copies give their anchors once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh(size)
        for batch in batches:
            for part in text_slices(batch, "text"):
                w = split_words(part.column("text"))
                h = fingerprints(w)
                cls = classes(h, w.first)
                anchor, _, row, _, _ = places(w, h, size)
                send = fresh(part.column("doc_id"), cls, w.first)[row]
                anchor, row = anchor[send], row[send]
                offsets = np.searchsorted(row, np.arange(part.num_rows + 1))
                buf, text_at = flat(part.column("text"))
                raw = buf.tobytes()
                sums = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest()
                        for a, b in zip(text_at[:-1], text_at[1:], strict=True)]
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(cls), pa.array(np.diff(w.first), pa.int64()), pa.array(sums),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(anchor))],
                    names=["doc_id", "cls", "n", "sha256", "anchors"])
    return run


def _places(size: int, seeds: np.ndarray, large: np.ndarray, of_large: bool):
    """The places of the seeds of large groups, or of the others (``PLACE``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh(size)
        for batch in batches:
            for part in text_slices(batch, "text"):
                w = split_words(part.column("text"))
                h = fingerprints(w)
                cls, ids = classes(h, w.first), part.column("doc_id").to_numpy()
                anchor, place, row, lo, hi = places(w, h, size)
                keep = fresh(part.column("doc_id"), cls, w.first)[row]
                keep[keep] = filters.let_through(anchor[keep], seeds)
                keep[keep] = filters.let_through(anchor[keep], large) == of_large
                anchor, place, row, lo, hi = (x[keep] for x in (anchor, place, row, lo, hi))
                marks = np.maximum(h & np.uint64((1 << 8 * BYTES) - 1), np.uint64(1)).astype("<u8")  # 0 stands for no word
                marks = marks.view(np.uint8).reshape(-1, 8)[:, :BYTES]
                for a in range(0, len(place), PORTION):
                    some = slice(a, a + PORTION)
                    length = size + hi[some] - lo[some]
                    ends = np.append(0, np.cumsum(length)) * BYTES
                    words = pa.Array.from_buffers(pa.binary(), len(length), [
                        None, pa.py_buffer(ends.astype(np.int32)),
                        pa.py_buffer(np.ascontiguousarray(marks[ragged(place[some] - hi[some], length)]))])
                    yield pa.record_batch(
                        [pa.array(anchor[some]), pa.array(ids[row[some]]), pa.array(cls[row[some]]),
                         pa.array((place - w.first[row])[some].astype(np.int32)), pa.array(hi[some].astype(np.int32)),
                         pa.array(lo[some].astype(np.int32)), pa.array(hi[some].astype(np.int32)), words],
                        names=["key", "doc_id", "cls", "at", "before", "lo", "hi", "words"])
    return run


def aligned(words: pa.Array, before: np.ndarray, size: int) -> np.ndarray:
    """The words of each row as numbers, one row each, with the anchor in the same columns; 0 where there are none."""
    reach = size - min(ANCHOR, size)
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(-1, BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :BYTES] = raw
    length = np.diff(ends) // BYTES
    out = np.zeros((len(words), size + reach), np.uint64)
    out[np.repeat(np.arange(len(words)), length), ragged(reach - before, length)] = wide.view("<u8").ravel()
    return out


def extend(mine: np.ndarray, its: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int):
    """Extends matches of rows with their representatives.

    Returns (first, last), the windows inside the match (none where first > last), and two parts (rows, key, lo, hi):
    what reaches beyond it on the left, and what does on the right only.
    """
    k = min(ANCHOR, size)
    reach, n, all_rows = size - k, len(key), np.arange(len(key))
    differ = mine != its
    edge = np.ones((n, 1), bool)
    left = np.concatenate([differ[:, :reach][:, ::-1], edge], axis=1).argmax(axis=1)
    right = np.concatenate([differ[:, reach + k:], edge], axis=1).argmax(axis=1)
    other = differ[:, reach:reach + k].any(axis=1)  # anchors that agree in their hash alone
    left[other] = -1
    first, last = np.maximum(lo, reach - right), np.minimum(hi, left)
    inner = (mine[:, reach:reach + k] * powers(GRAM, k)).sum(axis=1, dtype=np.uint64)

    def part(rows, side, length, word, lo, hi):
        way = mix(word ^ mix((length + 2 * side * size + 2).astype(np.uint64)))
        return rows, mix(key[rows].view(np.uint64) ^ way).view(np.int64), lo, hi

    rows = np.flatnonzero(left < hi)
    word = np.where(other, inner, mine[all_rows, np.clip(reach - 1 - left, 0, None)])[rows]
    beyond_left = part(rows, 0, left[rows], word, np.maximum(lo, left + 1)[rows], hi[rows])
    stop = np.minimum(last, reach - 1 - right)
    rows = np.flatnonzero(lo <= stop)
    word = mine[rows, np.clip(reach + k + right[rows], None, mine.shape[1] - 1)]
    return first, last, beyond_left, part(rows, 1, right[rows], word, lo[rows], stop[rows])


def refine(key, doc, at, lo, hi, mine: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Repeats of whole groups: (rows, first, last) of each step, as in :func:`extend`, until no group is left."""
    live = np.arange(len(key))
    while len(live):
        order = np.lexsort((at[live], doc[live], key))
        live, key, lo, hi = live[order], key[order], lo[order], hi[order]
        new = np.append(True, key[1:] != key[:-1])
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        tail = np.append(head[1:], len(live)) - 1
        keep = (doc[live[head]] < doc[live[tail]])[group]  # others are of one document
        rep = live[head][group][keep]
        live, key, lo, hi = live[keep], key[keep], lo[keep], hi[keep]
        first, last, beyond_left, beyond_right = extend(mine[live], mine[rep], key, lo, hi, size)
        hit = (first <= last) & (doc[rep] < doc[live])
        yield live[hit], first[hit], last[hit]
        live, key, lo, hi = (np.concatenate(x) for x in zip(
            *[(live[rows], *rest) for rows, *rest in (beyond_left, beyond_right)], strict=True))


def _refine(size: int):
    """(doc_id, cls, first, end) of the repeats of the groups of a task, whose rows are neighbours."""
    def spans(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, doc, cls, at, before, lo, hi = (rows.column(i).to_numpy() for i in range(7))
        mine = aligned(rows.column("words"), before, size)
        for found, first, last in refine(key, doc, at, lo, hi, mine, size):
            yield pa.record_batch([pa.array(doc[found]), pa.array(cls[found]), pa.array((at[found] - last).astype(np.int64)),
                                   pa.array((at[found] - first + size).astype(np.int64))], names=["doc_id", "cls", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key = batch.column("key").to_numpy()
            whole = len(key) - int((key[::-1] != key[-1]).argmax()) if key[0] != key[-1] else 0
            if whole:
                yield from spans(batch.slice(0, whole))
            rest = batch.slice(whole)
        if rest is not None:
            yield from spans(rest)
    return run


def _step(size: int):
    """One step of large groups: rows beside their representatives (``r_doc``, ``r_before``, ``r_words``) become
    repeats (``words`` null; ``lo``, ``hi``: first word, end) and parts that go on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key, doc, cls, at, before, lo, hi, r_doc, r_before = (
                batch.column(c).to_numpy() for c in ("key", "doc_id", "cls", "at", "before", "lo", "hi", "r_doc", "r_before"))
            first, last, *parts = extend(aligned(batch.column("words"), before, size),
                                         aligned(batch.column("r_words"), r_before, size), key, lo, hi, size)
            hit = np.flatnonzero((first <= last) & (r_doc < doc))
            out = [(hit, key[hit], at[hit] - last[hit], at[hit] - first[hit] + size, pa.nulls(len(hit), pa.binary()))]
            out += [(rows, k, a, b, batch.column("words").take(pa.array(rows))) for rows, k, a, b in parts]
            for rows, k, a, b, words in out:
                yield pa.record_batch(
                    [pa.array(k), pa.array(doc[rows]), pa.array(cls[rows]), pa.array(at[rows]), pa.array(before[rows]),
                     pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), words],
                    names=["key", "doc_id", "cls", "at", "before", "lo", "hi", "words"])
    return run


def maximal(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word spans (first, end) that repeats grow into."""
    if len(first) == 0:
        return np.zeros((0, 2), np.int64)
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(first[1:] > end[:-1])
    return np.stack([first[np.append(0, cut + 1)], end[np.append(cut, len(first) - 1)]], axis=1)


def _refined(rows: DataFrame, size: int) -> DataFrame:
    """Repeats of groups of bounded size, each inside one task."""
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(
        _refine(size), "doc_id long, cls long, first long, end long")


def _refined_large(todo: DataFrame, size: int, limit: int) -> list[DataFrame]:
    """Repeats of groups of any size: a join with the representatives for each step, until their parts are small."""
    found = []
    while not todo.isEmpty():
        rep = landed(todo.groupBy("key").agg(F.min(F.struct("doc_id", "at", "before", "words")).alias("rep"), F.max("doc_id").alias("most"))
                     .filter("rep.doc_id < most")
                     .select("key", F.col("rep.doc_id").alias("r_doc"), F.col("rep.before").alias("r_before"),
                             F.col("rep.words").alias("r_words")), "repeat-first")
        out = landed(join_dimension(todo, rep, "key").mapInArrow(_step(size), PLACE), "repeat-step")
        found.append(out.filter("words IS NULL").select(
            "doc_id", "cls", F.col("lo").cast("long").alias("first"), F.col("hi").cast("long").alias("end")))
        left = out.filter("words IS NOT NULL")
        sizes = landed(left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                       .filter("least < most").select("key", "n"), "repeat-sizes")
        small, large = (sizes.filter(F.col("n") <= limit).select("key"), sizes.filter(F.col("n") > limit).select("key"))
        found.append(landed(_refined(join_dimension(left, small, "key"), size), "repeat-small"))
        todo = landed(join_dimension(left, large, "key"), "repeat-large")
    return found


def find_repeats(docs: DataFrame, size: int = SIZE, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(survey, repeats): the rows' doc_id, cls, n, sha256, and the repeats (first word, end) by (doc_id, cls);
    only the first text of a class counts.  ``limit``: rows of a group that one task refines."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = landed(rows.mapInArrow(
        _survey(size), "doc_id long, cls long, n long, sha256 string, anchors array<bigint>"), "repeat-survey")
    seeds = landed(survey.select("cls", F.explode("anchors").alias("anchor"))
                   .groupBy("anchor").agg(F.min("cls").alias("one"), F.max("cls").alias("two"), F.count(F.lit(1)).alias("n"))
                   .filter("one != two").select("anchor", "n"), "repeat-seeds")
    some, large = filters.build(seeds, F.col("anchor")), filters.build(seeds.filter(F.col("n") > limit), F.col("anchor"))
    rows = rows.filter("doc_id IS NOT NULL")
    found = [landed(_refined(rows.mapInArrow(_places(size, some, large, False), PLACE), size), "repeat-few")]
    if large.any():
        found += _refined_large(landed(rows.mapInArrow(_places(size, some, large, True), PLACE), "repeat-many"), size, limit)
    spans = reduce(DataFrame.unionByName, found).groupBy("doc_id", "cls").agg(
        F.collect_list(F.struct("first", "end")).alias("spans"))
    return survey.drop("anchors"), landed(spans, "repeat-spans")


def _cut(with_text: bool):
    """Removes the words under the repeats of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                w = split_words(part.column("text"))
                removed, texts, spans = [], [], []
                raw = w.buf.tobytes()
                for r, of_row in enumerate(part.column("spans")):
                    a, b = w.first[r], w.first[r + 1]
                    found = maximal(of_row.values.field("first").to_numpy(), of_row.values.field("end").to_numpy())
                    keep = np.ones(b - a, bool)
                    for i, j in found:
                        keep[i:j] = False
                    removed.append(int((~keep).sum()))
                    texts.append(b" ".join(raw[x:y] for x, y in zip(w.start[a:b][keep], w.end[a:b][keep], strict=True)))
                    spans.append([{"first": int(i), "end": int(j)} for i, j in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("cls"), pa.array(removed, pa.int64()),
                     pa.array([t.decode() for t in texts] if with_text else [hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "cls", "n_removed", "kept", "repeats"])
    return run


def _with_class(wanted: np.ndarray):
    """(doc_id, cls, text) of the rows whose doc_id may be wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(filters.let_through(batch.column("hash").to_numpy(), wanted)))
            for part in text_slices(some, "text"):
                w = split_words(part.column("text"))
                yield pa.record_batch([part.column("doc_id"), pa.array(classes(fingerprints(w), w.first)), part.column("text")],
                                      names=["doc_id", "cls", "text"])
    return run


def cut_texts(docs: DataFrame, found: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, cls, n_removed, kept, repeats) of the texts that have repeats; ``kept``: the words left, joined
    by blanks (or its SHA-256), ``repeats``: the maximal repeats as word spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    wanted = filters.build(found.select("doc_id"), F.xxhash64("doc_id"))
    texts = rows.select("doc_id", F.xxhash64("doc_id").alias("hash"), "text") \
        .mapInArrow(_with_class(wanted), "doc_id long, cls long, text string").dropDuplicates(["doc_id", "cls"])
    return texts.join(found, ["doc_id", "cls"]).mapInArrow(
        _cut(with_text), "doc_id long, cls long, n_removed long, kept string, repeats array<struct<first: bigint, end: bigint>>")


def remove_repeats(docs: DataFrame, size: int = SIZE, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256."""
    survey, found = find_repeats(docs, size, limit)
    cut = landed(cut_texts(docs, found, with_text=False), "repeat-cut")
    least = landed(survey.groupBy("cls").agg(F.min("doc_id").alias("least")), "repeat-classes")
    copy = (F.col("n") >= size) & (F.col("doc_id") > F.col("least"))
    rows = survey.join(least, "cls")
    copies = rows.filter(copy).select("doc_id", "n", F.col("n").alias("n_removed"), F.lit(NOTHING).alias("kept_sha256"))
    first = rows.filter(~F.coalesce(copy, F.lit(False))).join(cut.drop("repeats"), ["doc_id", "cls"], "left").select(
        "doc_id", "n", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "sha256").alias("kept_sha256"))
    return first.unionByName(copies).withColumnRenamed("n", "n_words")


@register("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
