"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into pieces by code-point classes (letters, numbers, white space,
others, contractions) with array operations.  The distinct pieces of a batch lie
in one flat array of symbols; each round looks all neighbouring pairs up by
binary search over the sorted pair keys, merges in every piece its pairs of
lowest rank (leftmost first), and drops pieces that are done.  Decoding joins
the tokens' bytes.

Which code points are letters, numbers or blanks is taken from the library's own
splitting when a vocabulary is opened, so it follows the library's Unicode
version, not Python's.

Defined results: null and empty texts have no tokens.  The special token's
string inside a text is that token.  Texts of any length are encoded whole; memory
follows the batch or its longest text.  Pairs of equal rank merge from the left.
Repeated rows are encoded alike.  An empty table gives no rows.  A column named
like the one that is made is replaced by it; other columns pass through unread.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from insight.llm.base import documents, register
from insight.llm.words import CHUNK, Words, fingerprints, flat, ragged, text_slices

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: pieces whose tokens a task remembers; beyond it the memory starts anew
MEMORY = 300_000
#: rank of a pair that is no merge
NONE = np.int32(2**31 - 1)
#: what may follow an apostrophe as a piece of its own (fixed values)
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def code_point_classes(add_prefix_space: bool = False) -> np.ndarray:
    """Class of each code point, as the library itself splits: what makes one piece with letters is a letter, and so on.

    Runs of code points are tried whole, and those of mixed classes in shorter runs, some at a time, so that little is
    held."""
    from tokenizers.pre_tokenizers import ByteLevel

    splitter = ByteLevel(add_prefix_space=add_prefix_space, use_regex=True)
    classes = np.full(0x110000, OTHER, np.uint8)  # surrogates occur in no text
    todo = [(a, min(a + 256, 0x110000)) for a in range(0, 0x110000, 256) if not 0xD800 <= a < 0xE000]
    while todo:
        todo, later = todo[:64], todo[64:]
        kind = np.full(len(todo), SPACE, np.uint8)
        for probe, of in (("!", OTHER), ("a", LETTER), ("1", NUMBER)):
            open_ = np.flatnonzero(kind == SPACE)
            texts = [f" {probe}{''.join(map(chr, range(*todo[i])))}{probe}" for i in open_]
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            starts = np.unique([s for _, (s, _) in splitter.pre_tokenize_str("".join(texts))])
            whole = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - [len(t) for t in texts]) == 1
            kind[open_[whole]] = of
        rest = []
        for (a, b), k in zip(todo, kind, strict=True):
            if k == SPACE and b - a > 1:
                step = (b - a) // 16
                rest += [(s, min(s + step, b)) for s in range(a, b, step)]
            else:
                classes[a:b] = k
        todo = rest + later
    return classes


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        self._classes = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.byte_id = np.array([vocab[s] for s in symbols], np.int32)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        token = np.full(self.size, b"", object)
        for s, i in vocab.items():
            if s not in self.specials:
                token[i] = bytes(byte_of[c] for c in s)
        for s, i in self.specials.items():
            token[i] = s.encode()
        self.token = token
        self.decimal = np.array([b"%d" % i for i in range(self.size)], object)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # where the class of code points changes, and to what: short enough to travel with each task
        classes = code_point_classes()
        self.class_from = np.concatenate([[0], np.flatnonzero(np.diff(classes)) + 1])
        self.class_kind = classes[self.class_from]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        by = np.argsort(key, kind="stable")
        self.key, self.rank = key[by], by.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)[by]

    def classes(self) -> np.ndarray:
        if self._classes is None:
            self._classes = np.repeat(self.class_kind, np.diff(np.append(self.class_from, 0x110000)))
        return self._classes

    # --- pieces

    def pieces(self, buf: np.ndarray, offsets: np.ndarray) -> Words:
        """Cut valid UTF-8 texts into pieces (byte spans)."""
        if len(buf) == 0:
            return Words(buf, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
        lead = np.flatnonzero((buf & 0xC0) != 0x80)  # first byte of each character
        cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.classes()[cp]
        n = len(kind)
        row_start = np.zeros(n + 1, bool)
        row_start[np.searchsorted(lead, offsets)] = True
        row_start[n] = True
        cut = row_start.copy()
        cut[1:n] |= kind[1:] != kind[:-1]
        # the last of some white space before a piece: a blank joins the piece, another stands alone
        white = kind == SPACE
        before = np.flatnonzero(white[:-1] & ~white[1:] & ~row_start[1:n])
        cut[before] = True
        cut[before[cp[before] == 0x20] + 1] = False
        # contractions, where a piece starts with the apostrophe
        at = np.flatnonzero((cp == 0x27) & cut[:n])
        if len(at):
            end_of_row = np.flatnonzero(row_start)
            end_of_row = end_of_row[np.searchsorted(end_of_row, at, "right")]
            padded = np.concatenate([cp, np.zeros(2, np.uint32)])
            size = np.zeros(len(at), np.int64)
            for c in CONTRACTIONS:
                ok = at + 1 + len(c) <= end_of_row
                for k, x in enumerate(c):
                    ok &= padded[at + 1 + k] == ord(x)
                size[ok] = 1 + len(c)
            at, size = at[size > 0], size[size > 0]
            cut[ragged(at + 1, size - 1)] = False
            cut[at + size] = True
        first = np.flatnonzero(cut[:n])
        edge = np.concatenate([lead, [len(buf)]])
        start = edge[first]
        return Words(buf, start, np.concatenate([start[1:], [len(buf)]]), np.searchsorted(start, offsets))

    # --- merging

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over many pieces: ``first`` are their offsets in ``symbols``; token ids and new offsets."""
        n = len(first) - 1
        piece = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
        done_symbols, done_piece = [], []
        sym = symbols
        while len(sym):
            inner = np.zeros(len(sym), bool)
            inner[:-1] = piece[1:] == piece[:-1]
            at = np.flatnonzero(inner)
            key = sym[at].astype(np.int64) * self.size + sym[at + 1]
            found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.full(len(sym), NONE)
            hit = self.key[found] == key
            rank[at[hit]] = self.rank[found[hit]]
            target = np.zeros(len(sym), np.int32)
            target[at[hit]] = self.merged[found[hit]]
            heads = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            lowest = np.minimum.reduceat(rank, heads)
            lowest_at = np.repeat(lowest, np.diff(np.concatenate([heads, [len(sym)]])))
            active = lowest_at != NONE
            if not active.all():
                done_symbols.append(sym[~active])
                done_piece.append(piece[~active])
                sym, piece, rank, target, lowest_at = (x[active] for x in (sym, piece, rank, target, lowest_at))
                if not len(sym):
                    break
            chosen = rank == lowest_at
            # of a run of overlapping pairs every other one, from the left
            linked = np.zeros(len(sym), bool)
            linked[1:] = chosen[1:] & chosen[:-1] & (piece[1:] == piece[:-1])
            if linked.any():
                index = np.arange(len(sym))
                run = np.maximum.accumulate(np.where(linked, 0, index))
                chosen &= (index - run) % 2 == 0
            left = np.flatnonzero(chosen)
            sym = sym.copy()
            sym[left] = target[left]
            stay = np.ones(len(sym), bool)
            stay[left + 1] = False
            sym, piece = sym[stay], piece[stay]
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        ids, piece = np.concatenate(done_symbols), np.concatenate(done_piece)
        by = np.argsort(piece, kind="stable")
        return ids[by], np.searchsorted(piece[by], np.arange(n + 1))

    # --- columns

    def encoder(self) -> Encoder:
        return Encoder(self)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.token[ids]).decode("utf-8", errors="replace")


class Encoder:
    """Encodes columns; remembers the tokens of the pieces it has met, up to a bound."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, w: Words, hashes: np.ndarray, index: np.ndarray) -> None:
        start, size = w.start[index], w.end[index] - w.start[index]
        symbols = self.codec.byte_id[w.buf[ragged(start, size)]]
        ids, first = self.codec.merge(symbols, np.concatenate([[0], np.cumsum(size)]))
        slot = len(self.first) - 1 + np.arange(len(index))
        self.first = np.concatenate([self.first, first[1:] + self.first[-1]])
        self.ids = np.concatenate([self.ids, ids])
        joined = np.concatenate([self.hash, hashes])
        by = np.argsort(joined, kind="stable")
        self.hash, self.slot = joined[by], np.concatenate([self.slot, slot])[by]

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, offsets of each row)."""
        if any(s.encode() in column_bytes(column) for s in self.codec.specials):
            return self.with_specials(column)
        return self.plain(*flat(column))

    def plain(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.codec.pieces(buf, offsets)
        if len(w.start) == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        h = fingerprints(w)
        distinct, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > MEMORY:
            self.forget()
        at = np.searchsorted(self.hash, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hash)
        new[inside] = self.hash[at[inside]] != distinct[inside]
        if new.any():
            self.learn(w, distinct[new], index[new])
        slot = self.slot[np.searchsorted(self.hash, distinct)][inverse]
        start, size = self.first[slot], self.first[slot + 1] - self.first[slot]
        ids = self.ids[ragged(start, size)]
        until = np.concatenate([[0], np.cumsum(size)])
        return ids, until[w.first]

    def with_specials(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold a special token's string: the stretches between them are encoded apart."""
        import regex

        cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.codec.specials, key=len, reverse=True)))
        out, first = [], [0]
        for text in column.to_pylist():
            text = text or ""
            ids, last = [], 0
            for m in [*cut.finditer(text), None]:
                part = text[last:m.start() if m else len(text)].encode()
                ids.append(self.plain(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0])
                if m:
                    ids.append(np.array([self.codec.specials[m[0]]], np.int32))
                    last = m.end()
            out.append(np.concatenate(ids))
            first.append(first[-1] + len(out[-1]))
        return np.concatenate(out), np.array(first)


def column_bytes(column: pa.Array) -> bytes:
    return flat(column)[0].tobytes()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with its text column replaced by token ids (array of int)."""
    codec = Codec(path)
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), ids.lower())]
    docs = docs.select(*[f"`{c}`" for c in [*rest, text]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.encoder()
        for batch in batches:
            for part in text_slices(batch, text):
                flat_ids, first = encoder.column(part.column(text))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat_ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], lists], names=[*rest, ids])

    schema = "".join(f"`{c}` {t}, " for c, t in docs.select(*[f"`{c}`" for c in rest]).dtypes)
    return docs.mapInArrow(run, f"{schema}`{ids}` array<int>")


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with its ids column replaced by the decoded text (null ids: null)."""
    codec = Codec(path)
    rest = [c for c in docs.columns if c.lower() not in (ids.lower(), text.lower())]
    docs = docs.select(*[f"`{c}`" for c in [*rest, ids]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if v is None else codec.decode(np.asarray(v, np.int64)) for v in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(texts, pa.string())], names=[*rest, text])

    schema = "".join(f"`{c}` {t}, " for c, t in docs.select(*[f"`{c}`" for c in rest]).dtypes)
    return docs.mapInArrow(run, f"{schema}`{text}` string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the decoded text, encoded and decoded in one pass."""
    codec = Codec(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.encoder()
        for batch in batches:
            for part in text_slices(batch, "text", CHUNK // 2):
                ids, first = encoder.column(part.column("text"))
                of_ids, of_text = [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    own = ids[a:b]
                    of_ids.append(hashlib.sha256(b",".join(codec.decimal[own])).hexdigest())
                    of_text.append(hashlib.sha256(codec.decode(own).encode()).hexdigest())
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(first), pa.int64()),
                                       pa.array(of_ids), pa.array(of_text)],
                                      names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op4_bpe_round_trip")
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), vocabulary())
