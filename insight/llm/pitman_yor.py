"""Hierarchical Pitman-Yor language model, trained and applied as Spark jobs.

A restaurant for each context (the word before, known by its whole fingerprint)
serves words; its tables are the customers of one parent restaurant that all
contexts share, whose base is uniform over the known words and one unknown.
Seating is sampled by Gibbs: in every sweep the customers of each dish leave and
are seated anew by the Chinese-restaurant rule, given all others; the sweeps of
all restaurants run at once, on the totals of the sweep before.  The predictive
probabilities of the last ``KEPT`` sweeps are averaged and their log10 summed
over each text, which gives perplexities.

Texts are read in packs of about ``PACK`` tokens.  A pack sends each distinct
(word, context) pair once, with its training count, to a cell: that of the
word's hash, or, for words of at least ``HOT_SHARE`` of all tokens (fewer than
300), one of other cells by the context's hash.  So neither a frequent word nor a
frequent pair fills a cell.  Cells count, sample and score their pairs.  A
context's totals concern many cells: these send their parts to the totals' own
groups, by ranges of the context's fingerprint, and get the sums back in the
same order, in every sweep; contexts that only one cell knows are settled there.  Cells answer each pack with a number a pair; the
pack adds them up by text.  The driver holds sums over all cells, and those of
each word that is spread.

Defined results: null and empty texts have the end token only.  A null doc_id
belongs to the training rows.  Rows repeating a doc_id count and are scored each.
Texts are taken whole, whatever their length.  An empty table gives no rows.
Columns beside doc_id and text are not read, so clashing names do no harm.
Equal counts are no ties that decide anything: seats are drawn from seeds by cell and sweep.
Words are compared by 64-bit fingerprints; a pair's log10 probability is sent as a 32-bit number.
"""

from __future__ import annotations

import contextlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.llm.base import delete_path, documents, landed, register
from insight.llm.words import CHUNK, fingerprints, mix, split_words, text_slices
from insight.session import scratch_path

#: a word is spread over cells by its contexts if it makes up this part of all tokens
HOT_SHARE = 1 / 256
#: words that a reading task counts at once; what it drops is at most 1/COUNTED of its tokens for each word
COUNTED = 1 << 16
#: sweeps of the sampler, and how many of the last ones are averaged
SWEEPS = 3
KEPT = 2
#: concentration of the contexts and of the parent
STRENGTH = 2.0
PARENT_STRENGTH = 10.0
#: texts sent to a Python task at once
BATCH_ROWS = 500
#: tokens packed at once, and rows of such a pack at most
PACK = 2_000_000
PACK_ROWS = 60_000
#: contexts told by cells that one range of the totals takes, about (the 64-bit fingerprints are even)
RANGE = 1 << 19
END = mix(np.array([0x656E64], np.uint64))[0]


# --- events

def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, offsets): the words of each row and its end; the first one's context is the end."""
    w = split_words(column, lower=True)
    h = fingerprints(w)
    rows = len(w.first) - 1
    first = w.first + np.arange(rows + 1)
    out = np.full(len(h) + rows, END, np.uint64)
    at = np.arange(len(h)) + w.row
    out[at] = h
    before = np.empty(len(out), np.uint64)
    before[1:] = out[:-1]
    before[first[:-1]] = END
    return out, before, first


@contextlib.contextmanager
def lean(spark: SparkSession):
    """Within it, Python tasks get few texts at once, and tables of long binary values are written by a codec that
    streams (Snappy needs each page whole)."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.parquet.compression.codec": "zstd"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def frequent(docs: DataFrame) -> np.ndarray:
    """Fingerprints of the words to spread: all that make up ``HOT_SHARE`` of the table's tokens, and some a little
    below.  Counted over the whole table, each reading task's counts added up."""
    parts = landed(docs.select("text").mapInArrow(_heavy(HOT_SHARE), "word long, n long, tokens long"), "word-counts")
    total = parts.agg(F.sum("tokens")).first()[0] or 0
    # a task leaves out words below 1/128 of the share: with what it dropped, less than 1/64 in all
    rows = parts.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= total * HOT_SHARE * 63 / 64)
    return np.sort(np.array([r.word for r in rows.select("word").collect()], np.int64).view(np.uint64))


def add_counts(word: np.ndarray, count: np.ndarray, more: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of sorted distinct words with the tokens ``more``: beyond ``most`` words, all counts fall by that of the
    next one and words at 0 go (a Misra-Gries summary: no count is short by more than tokens / most)."""
    w, n = np.unique(more, return_counts=True)
    both, inverse = np.unique(np.concatenate([word, w]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([count, n]), len(both)).astype(np.int64)
    if len(both) > most:
        total -= np.partition(total, len(both) - most - 1)[len(both) - most - 1]
    return both[total > 0], total[total > 0]


def _heavy(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, count, tokens_ = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            for part in text_slices(batch, "text", CHUNK // 4):
                found = tokens(part.column("text"))[0]
                word, count = add_counts(word, count, found, COUNTED)
                tokens_ += len(found)
        often = count >= tokens_ * share / 128
        word, count = word[often].view(np.int64), count[often]
        yield pa.record_batch([pa.array(np.append(word, 0)), pa.array(np.append(count, 0)),
                               pa.array(np.append(np.zeros(len(word), np.int64), tokens_))], names=["word", "n", "tokens"])
    return run


#: arrays in rising order, kept as differences
RISING = {"words", "met", "word", "context", "key", "slots"}


def squeezed(name: str, x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed (Spark's own codec for shuffles finds little in whole numbers)."""
    if len(x) == 0:
        return b""
    if name in RISING:
        x = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes())


def unsqueezed(name: str, data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if name in RISING else x


def arrays_of(row: dict, **kinds) -> tuple:
    return tuple(unsqueezed(name, row[name], kind) for name, kind in kinds.items())


EVENTS = ("cell int, pack long, part int, spread boolean, words binary, counts binary, met binary, contexts binary, trained binary, "
          "uses binary, events binary, ids array<bigint>, sizes array<int>, held binary")


def bucket_labels(spark: SparkSession, n: int) -> np.ndarray:
    """``n`` numbers that a table of ``n`` buckets keeps in a bucket each (cells dealt by their own number would share some)."""
    tried = spark.range(64 * n).select(F.col("id").cast("int").alias("id"))
    rows = tried.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("bucket")).agg(F.min("id").alias("id")).collect()
    found = {r.bucket: r.id for r in rows}
    # a bucket that none of them hit shares another's
    return np.array([found.get(k, k) for k in range(n)], np.int64)


def distinct_pairs(word: np.ndarray, context: np.ndarray, learned: np.ndarray, hot: np.ndarray, cells: int):
    """(cell, word, context, training count) of each distinct pair, by cell, word and context; and each event's pair."""
    names = np.unique(np.concatenate([word, context]))
    code = np.searchsorted(names, word) * len(names) + np.searchsorted(names, context)
    code, inverse = np.unique(code, return_inverse=True)
    w, c = names[code // len(names)], names[code % len(names)]
    cell = ((w >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)
    spread = np.isin(w, hot)
    cell[spread] = cells + ((mix(c[spread]) >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    trained = np.bincount(inverse, learned, len(code))
    return cell[order], w[order], c[order], trained[order].astype(np.uint32), place[inverse]


def messages(cell, word, context, trained) -> Iterator[tuple]:
    """(cell, words, contexts of each word, distinct contexts, context numbers, training counts) of each cell."""
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(cell) != 0]))
    for a, b in zip(cuts, np.append(cuts[1:], len(cell)), strict=True):
        head = np.flatnonzero(np.concatenate([[True], word[a + 1:b] != word[a:b - 1]]))
        met, number = np.unique(context[a:b], return_inverse=True)
        yield (int(cell[a]), squeezed("words", word[a:b][head]), squeezed("counts", np.diff(np.append(head, b - a)).astype(np.uint32)),
               squeezed("met", met), squeezed("contexts", number.astype(np.uint32)), squeezed("trained", trained[a:b]))


def _events(cells: int, labels: np.ndarray, hot: np.ndarray, holds):
    names = [x.split(" ")[0] for x in EVENTS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 7, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = TaskContext.get().partitionId() << 24
        texts: list[tuple] = []

        def flush():
            nonlocal pack, texts
            ids = [i for part in texts for i in part[0]]
            sizes = np.concatenate([p[1] for p in texts])
            held = np.array([holds(i) for i in ids], bool)
            word, context = (np.concatenate([p[k] for p in texts]) for k in (2, 3))
            *pairs, events = distinct_pairs(word, context, np.repeat(~held, sizes), hot, cells)
            none = (None,) * 5
            # each pair's events by their texts
            row = np.repeat(np.arange(len(ids)), sizes)[np.argsort(events, kind="stable")]
            rows = [(int(labels[cell]), pack, part, cell >= cells, *arrays, *none)
                    for part, (cell, *arrays) in enumerate(messages(*pairs))]
            rows.append((int(labels[pack % len(labels)]), pack, None, None, *none, squeezed("uses", np.bincount(events).astype(np.uint32)),
                         squeezed("events", row.astype(np.uint16)), ids, sizes.astype(np.int32).tolist(), held.tobytes()))
            pack, texts = pack + 1, []
            for i in range(0, len(rows), 16):
                yield pa.record_batch([pa.array([r[k] for r in rows[i:i + 16]], t) for k, t in enumerate(kinds)], names=names)

        n = rows = 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                word, context, first = tokens(part.column("text"))
                if texts and (n + len(word) > PACK or rows + part.num_rows > PACK_ROWS):
                    yield from flush()
                    n = rows = 0
                texts.append((part.column("doc_id").to_pylist(), np.diff(first), word, context))
                n, rows = n + len(word), rows + part.num_rows
        if texts:
            yield from flush()
    return run


# --- one cell

WIDTH = 32


class Cell:
    """A cell's words with their training counts in every context."""

    def __init__(self, word: np.ndarray, context: np.ndarray, key: np.ndarray, count: np.ndarray, spread: bool = False):
        self.word = word          # sorted fingerprints of words learned
        self.context = context    # sorted fingerprints of all contexts met, learned from or not
        self.key = key            # (number of the word, number of the context), sorted
        self.count = count        # customers
        self.spread = spread      # its words have pairs in other cells too
        self.of, self.at = key >> WIDTH, key & ((1 << WIDTH) - 1)
        self.total = np.bincount(self.of, count, len(word)).astype(np.int64)
        self.dishes = np.bincount(self.of, minlength=len(word))

    @classmethod
    def of_messages(cls, parts: list[tuple], spread: bool = False) -> Cell:
        """From (words, contexts of each word, distinct contexts, context numbers, training counts) of several packs."""
        none = np.zeros(0, np.uint64)
        word = np.unique(np.concatenate([none, *(p[0] for p in parts)]))
        context = np.unique(np.concatenate([none, *(p[2] for p in parts)]))
        keys = [np.zeros(0, np.int64)]
        for w, n, met, number, trained in parts:
            key = np.repeat(np.searchsorted(word, w) << WIDTH, n) | np.searchsorted(context, met)[number]
            keys.append(key[trained > 0])
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([np.zeros(0), *(p[4][p[4] > 0] for p in parts)]), len(key)).astype(np.int64)
        used, of = np.unique(key >> WIDTH, return_inverse=True)
        return cls(word[used], context, of.astype(np.int64) << WIDTH | key & ((1 << WIDTH) - 1), count, spread)


def seat(customers: np.ndarray, ratio: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that the customers of each dish open, seated one after another.

    The j-th customer opens a table with chance ``a / (a + j - d t)``: ``a`` is
    the weight of a new table over the base, ``ratio``, ``t`` the tables so far.
    The first 32 are seated one by one; of later ones, blocks of an eighth of
    those seated share one chance and draw the number of tables binomially.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    seated = tables.copy()
    active = np.flatnonzero(customers > 1)
    while len(active):
        j, t = seated[active], tables[active]
        block = np.minimum(np.where(j < 32, 1, j // 8), customers[active] - j)
        a = ratio[active]
        chance = a / (a + np.maximum(j - discount * t, 1e-9))
        new = np.where(block == 1, rng.random(len(active)) < chance, 0).astype(np.int64)
        many = block > 1
        if many.any():
            new[many] = rng.binomial(block[many], chance[many])
        tables[active] = t + new
        seated[active] = j + block
        active = active[seated[active] < customers[active]]
    return tables


class Parent:
    """The parent restaurant after a sweep: customers and tables in all, and those of each word that is spread."""

    def __init__(self, customers: float, tables: float, hot_customers: np.ndarray, hot_tables: np.ndarray):
        self.customers, self.tables, self.hot_customers, self.hot_tables = customers, tables, hot_customers, hot_tables


class Shared:
    """Fixed numbers: known words, training tokens, discounts; the words that are spread and their training counts."""

    def __init__(self, known: int, trained: int, discount: float, parent_discount: float, hot: np.ndarray, hot_counts: np.ndarray):
        self.known, self.trained, self.discount, self.parent_discount = known, trained, discount, parent_discount
        self.hot, self.hot_counts = hot, hot_counts

    def opened(self, parent: Parent) -> float:
        """Weight of a new table of the parent's over its base."""
        return (PARENT_STRENGTH + self.parent_discount * parent.tables) / (self.known + 1)

    def new_table(self, parent: Parent) -> float:
        """Parent's chance of a word by a new table, for each known word and for the unknown one."""
        return self.opened(parent) / (PARENT_STRENGTH + parent.customers)

    def base(self, parent: Parent, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Parent's chance of words with so many customers and tables there."""
        return (customers - self.parent_discount * tables) / (PARENT_STRENGTH + parent.customers) + self.new_table(parent)


def words_at_parent(cell: Cell, shared: Shared, parent: Parent, state) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of the cell's words at the parent: its own, or those of all cells for words that are spread."""
    if not cell.spread:
        return state[1], state[2]
    at = np.searchsorted(shared.hot, cell.word)
    return parent.hot_customers[at], parent.hot_tables[at]


class Told:
    """What a cell is told of its contexts: their customers, which of them other cells know too, and the tables of
    those after each round."""

    def __init__(self, customers: np.ndarray, shared: np.ndarray, tables: list[np.ndarray]):
        self.customers, self.shared, self.tables = customers, shared, tables

    def all_tables(self, cell: Cell, tables: np.ndarray, after: int) -> np.ndarray:
        """Tables of each context, the cell's own being ``tables``."""
        out = np.bincount(cell.at, tables, len(cell.context)).astype(np.int64)
        out[self.shared] = self.tables[after]
        return out


def sweeps(cell: Cell, shared: Shared, parents: list[Parent], told: Told, seed: int) -> Iterator[tuple]:
    """After each sweep: tables of every (word, context), customers and tables of each word at the parent.

    Starts with one table for each dish of a restaurant; sweep ``s`` seats against
    ``parents[s]`` and what was told after round ``s``.
    """
    tables = np.ones(len(cell.key), np.int64)
    state = tables, cell.dishes, np.minimum(cell.dishes, 1)
    for s, parent in enumerate(parents):
        rng = np.random.default_rng([seed, s])
        base = shared.base(parent, *words_at_parent(cell, shared, parent, state))
        others = told.all_tables(cell, state[0], s)[cell.at] - state[0]  # tables of the other dishes
        ratio = (STRENGTH + shared.discount * np.maximum(others, 0)) * base[cell.of]
        tables = seat(cell.count, ratio, shared.discount, rng)
        customers = np.bincount(cell.of, tables, len(cell.word)).astype(np.int64)
        # a spread word's tables are drawn once, from the customers of all cells
        opened = customers if cell.spread else seat(
            customers, np.full(len(customers), shared.opened(parent)), shared.parent_discount, rng)
        state = tables, customers, opened
        yield state


class Predictor:
    """Averaged predictive probabilities of one cell's words: of a pair what it has itself, and for each sample the
    contexts' share of the parent and the parent's chance of the words."""

    def __init__(self, cell: Cell, shared: Shared, parents: list[Parent], told: Told, seed: int):
        states = list(sweeps(cell, shared, parents[:-1], told, seed))
        room = STRENGTH + told.customers
        self.word, self.context, self.key = cell.word, cell.context, cell.key
        self.total = shared.hot_counts[np.searchsorted(shared.hot, cell.word)] if cell.spread else cell.total
        self.here, self.share, self.base = np.zeros(len(cell.key)), [], []
        for after in range(len(parents) - KEPT, len(parents)):
            state, parent = states[after - 1], parents[after]
            self.here += (cell.count - shared.discount * state[0]) / room[cell.at] / KEPT
            self.share.append((STRENGTH + shared.discount * told.all_tables(cell, state[0], after)) / room / KEPT)
            # the last one is the unknown word
            self.base.append(np.append(shared.base(parent, *words_at_parent(cell, shared, parent, state)), shared.new_table(parent)))

    KINDS = {"word": np.uint64, "context": np.uint64, "key": np.int64, "total": np.int64, "here": np.float64,
             "share": np.float64, "base": np.float64}

    def packed(self) -> dict[str, bytes]:
        return {name: squeezed(name, np.asarray(getattr(self, name), kind).ravel()) for name, kind in self.KINDS.items()}

    @classmethod
    def unpacked(cls, row: dict) -> Predictor:
        self = cls.__new__(cls)
        for name, x in zip(cls.KINDS, arrays_of(row, **cls.KINDS), strict=True):
            setattr(self, name, x)
        self.share, self.base = self.share.reshape(KEPT, -1), self.base.reshape(KEPT, -1)
        return self

    def counts(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word, the unknown one's for those not learned; training count)."""
        at = np.searchsorted(self.word, word)
        known = self.word[np.minimum(at, len(self.word) - 1)] == word if len(self.word) else np.zeros(len(word), bool)
        return np.where(known, at, len(self.word)), np.append(self.total, 0)[np.where(known, at, len(self.word))]

    def log10(self, at: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10 probability of words by place, after contexts (numbers in the cell)."""
        key = at << WIDTH | context
        pair = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        total = np.where(self.key[pair] == key, self.here[pair], 0.0) if len(self.key) else np.zeros(len(key))
        for share, base in zip(self.share, self.base, strict=True):
            total = total + share[context] * base[at]
        return np.log10(total)


# --- jobs

COUNTS = ("cell int, spread boolean, word binary, context binary, key binary, count binary, contexts long, pairs long, once long, twice long, "
          "single long, double long, known long, trained long, hot_counts array<bigint>, hot_dishes array<bigint>")
FINAL = "cell int, word binary, context binary, key binary, total binary, here binary, share binary, base binary"


def cell_of(row: dict) -> Cell:
    return Cell(*arrays_of(row, word=np.uint64, context=np.uint64, key=np.int64, count=np.int64), spread=row["spread"])


def for_hot(cell: Cell, hot: np.ndarray, values: np.ndarray) -> list[int] | None:
    """The cell's part of a number that each spread word has."""
    if not cell.spread:
        return None
    out = np.zeros(len(hot), np.int64)
    out[np.searchsorted(hot, cell.word)] = values
    return out.tolist()


def message_arrays(row: dict) -> tuple:
    return arrays_of(row, words=np.uint64, counts=np.uint32, met=np.uint64, contexts=np.uint32, trained=np.uint32)


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
             "array<bigint>": pa.list_(pa.int64())}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def _count(hot: np.ndarray):
    """Each cell's counts, and its part of the sums that all cells share."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        c = Cell.of_messages([message_arrays(r) for r in rows], rows[0]["spread"])
        few = [0, 0, 0] if c.spread else [int((c.dishes == 1).sum()), int((c.dishes == 2).sum()), len(c.word)]
        return table_of([(key[0].as_py(), c.spread, *(squeezed(n, getattr(c, n)) for n in ("word", "context", "key", "count")), len(c.context), len(c.key),
                          int((c.count == 1).sum()), int((c.count == 2).sum()), *few, int(c.count.sum()),
                          for_hot(c, hot, c.total), for_hot(c, hot, c.dishes))], COUNTS)
    return run


def ranges_for(contexts: int, cells: int) -> int:
    """Ranges of the contexts' totals: as many as their number asks for, so that small tables in many partitions are not
    cut into cells x cells messages of a few numbers each."""
    return max(1, min(cells, -(-contexts // RANGE)))


def context_ranges(context: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """Stretches of sorted fingerprints by range; stretch by stretch they are the whole again."""
    number = ((context >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(number.astype(np.int64)) != 0])) if len(context) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(context)), strict=True):
        yield int(number[a]), slice(a, b)


ASKED = "bucket int, cell int, context binary, customers binary, tables binary"
TOTALS = "bucket int, cell int, shared binary, slots binary, customers binary, tables binary"
SWEPT = "bucket int, cell int, tables binary, customers long, opened long, hot array<bigint>"
REPLIES = "bucket int, cell int, tables binary"


def _ask(ranges: int):
    """Each cell's contexts with their customers and dishes in it, by range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                c = cell_of(row)
                customers = np.bincount(c.at, c.count, len(c.context)).astype(np.int64)
                dishes = np.bincount(c.at, minlength=len(c.context))
                rows = [(k, row["cell"], squeezed("context", c.context[s]), squeezed("customers", customers[s]), squeezed("tables", dishes[s]))
                        for k, s in context_ranges(c.context, ranges)]
                yield from table_of(rows, ASKED).to_batches()
    return run


def _first_totals(key: tuple, table: pa.Table) -> pa.Table:
    """A range's contexts over all cells: to each cell which of its contexts others know too, their places here, their
    customers and dishes."""
    rows = table.to_pylist()
    parts = [arrays_of(r, context=np.uint64, customers=np.int64, tables=np.int64) for r in rows]
    names = np.unique(np.concatenate([p[0] for p in parts]))
    slots = [np.searchsorted(names, p[0]) for p in parts]
    every = np.concatenate(slots)
    customers, tables = (np.bincount(every, np.concatenate([p[k] for p in parts])).astype(np.int64) for k in (1, 2))
    met = np.bincount(every)
    out = []
    for r, s, (_, own, _) in zip(rows, slots, parts, strict=True):
        # also one that another cell only asks for, in texts that are not learned from
        shared = (met[s] > 1) & (customers[s] > 0)
        at = s[shared]
        out.append((key[0].as_py(), r["cell"], squeezed("shared", shared), squeezed("slots", at.astype(np.uint32)),
                    squeezed("customers", np.where(shared, customers[s], own)), squeezed("tables", tables[at])))
    return table_of(out, TOTALS)


def _next_totals(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The same after a sweep: the tables of each context."""
    parts = [(r["cell"], *arrays_of(r, tables=np.int64)) for r in left.to_pylist()]
    if not parts:
        return table_of([], REPLIES)
    slots = {r["cell"]: arrays_of(r, slots=np.uint32)[0] for r in right.to_pylist()}
    every = np.concatenate([slots[cell] for cell, _ in parts])
    tables = np.bincount(every, np.concatenate([t for _, t in parts])).astype(np.int64)
    return table_of([(key[0].as_py(), cell, squeezed("tables", tables[slots[cell]])) for cell, _ in parts], REPLIES)


def told_by(replies: pa.Table, rounds: int) -> Told:
    rows = sorted(replies.to_pylist(), key=lambda r: r["bucket"])

    def joined(name, kind, after):
        return np.concatenate([np.zeros(0, kind), *(arrays_of(r, **{name: kind})[0] for r in rows if r["round"] == after)])

    return Told(joined("customers", np.int64, 0), joined("shared", np.bool_, 0), [joined("tables", np.int64, k) for k in range(rounds)])


def _sweep(shared: Shared, parents: list[Parent], ranges: int):
    """A cell's tables by context after the sweep behind ``parents``, and its part of the parent's sums."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        cell = cell_of(row)
        told = told_by(right, len(parents))
        *_, (tables, customers, opened) = sweeps(cell, shared, parents, told, row["cell"])
        here = np.bincount(cell.at, tables, len(cell.context)).astype(np.int64)
        rows = [(k, row["cell"], squeezed("tables", here[s][told.shared[s]]), None, None, None)
                for k, s in context_ranges(cell.context, ranges) if told.shared[s].any()]
        rows.append((None, row["cell"], None, int(customers.sum()), 0 if cell.spread else int(opened.sum()),
                     for_hot(cell, shared.hot, customers)))
        return table_of(rows, SWEPT)
    return run


def _finish(shared: Shared, parents: list[Parent]):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        model = Predictor(cell_of(row), shared, parents, told_by(right, len(parents)), row["cell"])
        return table_of([(row["cell"], *model.packed().values())], FINAL)
    return run


def discount_of(once: int, twice: int) -> float:
    """Estimate from how many counts are 1 and 2, kept away from 0 and 1."""
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5


ANSWERS = "home int, pack long, part int, score binary, counts binary, total binary"


def _score(labels: np.ndarray):
    """A cell's answers to each pack: log10 probabilities of its pairs, training counts of its words."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = right.to_pylist()
        model = Predictor.unpacked(row)
        out = []
        for r in left.to_pylist():
            w, n, met, number, _ = message_arrays(r)
            at, total = model.counts(w)
            score = model.log10(np.repeat(at, n), np.searchsorted(model.context, met)[number])
            out.append((int(labels[r["pack"] % len(labels)]), r["pack"], r["part"],
                        squeezed("score", score.astype(np.float32)), r["counts"], squeezed("total", total)))
        return table_of(out, ANSWERS)
    return run


def _gather(shared: Shared):
    """The texts of some packs from the answers of all cells."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        answers: dict[int, list[dict]] = {}
        for r in sorted(right.to_pylist(), key=lambda r: r["part"]):
            answers.setdefault(r["pack"], []).append(r)
        out: list[pa.Table] = []
        for info in left.to_pylist():
            parts = [arrays_of(r, score=np.float32, counts=np.uint32, total=np.int64) for r in answers.pop(info["pack"])]
            score = np.concatenate([p[0] for p in parts]).astype(np.float64)
            total = np.concatenate([np.repeat(p[2], p[1]) for p in parts])
            uses, row = arrays_of(info, uses=np.uint32, events=np.uint16)
            size = np.array(info["sizes"], np.int64)

            def by_text(x, row=row, uses=uses, n=len(size)):
                return np.bincount(row, np.repeat(x, uses), n)

            base = by_text(np.log10(total + 1)) - size * np.log10(shared.trained + shared.known + 1)
            out.append(pa.table({
                "doc_id": pa.array(info["ids"], pa.int64()), "held_out": pa.array(np.frombuffer(info["held"], bool)),
                "n_tokens": pa.array(size), "n_known": pa.array(by_text(total > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(size), shared.trained)), "base_score": pa.array(base),
                "score": pa.array(by_text(score))}))
        return pa.concat_tables(out)
    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Bucketed:
    """Tables bucketed by a number, as long as one run of the model needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def write(self, df: DataFrame, buckets: int, by: str, name: str) -> DataFrame:
        table, path = f"pitman_yor_{name}_{uuid.uuid4().hex}", scratch_path(self.spark, name)
        df.write.bucketBy(buckets, by).option("path", path).saveAsTable(table)
        self.made.append((table, path))
        return self.spark.table(table)

    def drop(self, name: str = "") -> None:
        """Those whose name begins so."""
        for table, path in self.made:
            if table.startswith(f"pitman_yor_{name}"):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                delete_path(self.spark, path)


def train_and_score(docs: DataFrame, holds, seed: int = 17) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    ``holds(doc_id)`` (a plain function) names the rows that are not learned from.
    """
    spark = docs.sparkSession
    tables = Bucketed(spark)
    with lean(spark):
        try:
            return _train_and_score(docs, holds, seed, tables)
        finally:
            tables.drop()


def _train_and_score(docs: DataFrame, holds, seed: int, tables: Bucketed) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # as many buckets as cells, with those of the spread words
    buckets = 2 * cells
    labels = bucket_labels(spark, buckets)
    hot = frequent(rows)
    # what concerns a cell lies in one bucket, here and in the tables of counts: what follows reads them without a shuffle
    events = tables.write(rows.mapInArrow(_events(cells, labels, hot, holds), EVENTS).repartition(buckets, "cell"), buckets, "cell", "events")
    packed, info = events.filter("words is not null"), events.filter("ids is not null")
    counts = tables.write(packed.groupBy("cell").applyInArrow(_count(hot), COUNTS), buckets, "cell", "counts")

    def hot_sum(df: DataFrame, column: str) -> np.ndarray:
        out = np.zeros(len(hot), np.int64)
        for r in df.select(F.posexplode(column).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = r["n"]
        return out

    names = ("contexts", "pairs", "once", "twice", "single", "double", "known", "trained")
    contexts, pairs, once, twice, single, double, known, trained = (
        x or 0 for x in counts.agg(*[F.sum(c).alias(c) for c in names]).first())
    # spread words count as any other does, over all their cells
    hot_counts, dishes = hot_sum(counts, "hot_counts"), hot_sum(counts, "hot_dishes")
    single, double, known = single + int((dishes == 1).sum()), double + int((dishes == 2).sum()), known + int((dishes > 0).sum())
    shared = Shared(known, trained, discount_of(once, twice), discount_of(single, double), hot, hot_counts)

    # at first a table for each dish
    ranges = ranges_for(contexts, cells)
    asked = tables.write(counts.mapInArrow(_ask(ranges), ASKED).groupBy("bucket").applyInArrow(_first_totals, TOTALS),
                         cells, "bucket", "contexts")
    totals = asked.agg(F.count(F.lit(1)).alias("n")).first().n
    if not totals:
        return landed(spark.createDataFrame([], SCORES), "scores")
    replies = asked.select("bucket", "cell", "tables", "customers", "shared", F.lit(0).alias("round"))
    parents = [Parent(pairs, known, dishes, np.minimum(dishes, 1))]
    for sweep in range(SWEEPS):
        swept = landed(counts.groupBy("cell").cogroup(replies.groupBy("cell")).applyInArrow(
            _sweep(shared, parents, ranges), SWEPT), "swept")
        sums = swept.agg(F.sum("customers").alias("customers"), F.sum("opened").alias("opened")).first()
        customers = hot_sum(swept, "hot")
        opened = seat(customers, np.full(len(hot), shared.opened(parents[-1])), shared.parent_discount,
                      np.random.default_rng([seed, sweep]))
        parents.append(Parent(sums.customers, sums.opened + int(opened.sum()), customers, opened))
        answer = landed(swept.filter("bucket is not null").select("bucket", "cell", "tables").groupBy("bucket")
                        .cogroup(asked.select("bucket", "cell", "slots").groupBy("bucket")).applyInArrow(_next_totals, REPLIES), "totals")
        replies = replies.unionByName(answer.select(
            "bucket", "cell", "tables", F.lit(None).cast("binary").alias("customers"), F.lit(None).cast("binary").alias("shared"),
            F.lit(sweep + 1).alias("round")))

    final = tables.write(counts.groupBy("cell").cogroup(replies.groupBy("cell")).applyInArrow(_finish(shared, parents), FINAL),
                         buckets, "cell", "final")
    tables.drop("counts")
    tables.drop("contexts")
    answers = packed.select("cell", "pack", "part", "words", "counts", "met", "contexts", "trained").groupBy("cell") \
        .cogroup(final.groupBy("cell")).applyInArrow(_score(labels), ANSWERS)
    scores = info.select("cell", "pack", "uses", "events", "ids", "sizes", "held").groupBy("cell") \
        .cogroup(answers.groupBy("home")).applyInArrow(_gather(shared), SCORES)
    return landed(scores, "scores")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity a token of the model and of the base, of the rows learned from and of the others."""
    def of(score):
        return F.pow(F.lit(10.0), -F.sum(score) / F.sum("n_tokens"))

    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))


def seventh(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@register("op2_pitman_yor")
def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(documents(spark, sf_dir), seventh)
