"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct word n-grams; documents link when the
Jaccard similarity of their sets reaches the threshold ``t``.  With all sets in
one global order (rare first), two sets that link share at least ``m`` of their
first ``n - ceil(t n) + m`` elements, for every ``m``.  Each document picks its
own ``m``: a longer prefix costs more postings but asks for more shared elements,
so it pays where the first elements are frequent.  Frequencies come from a
fixed-size count sketch of all documents; they only steer the order and the
choice of ``m``, never the result.

1. One pass: class (fingerprint of the whole set) of every row, and the sketch.
   Rows with equal sets are one class from here on.
2. Prefix postings meet by element and band of sizes; lone ones are dropped.  The
   first class of such a run is its pivot; classes joined over pivots form
   clusters.  Classes with fewer shared elements than ``m`` asks for leave, and
   inside a cluster only classes that share at least ``m`` (the smaller of their
   two numbers) stay together.
3. The few classes left send their whole sets to their groups, in blocks of
   bounded size.  Overlaps inside a group are counted exactly through an inverted
   list; a group returns a forest of its links, not its pairs.  A cluster beyond
   one task is compared pivot by pivot instead.
4. Components by contraction: rounds that shrink the links.

Defined results: null, empty and wordless texts have an empty set and link with
nothing; a text with fewer words than ``n`` has its whole word sequence as its one
element.  Rows repeating a doc_id are texts of their own.  A component's id is the smallest
doc_id in it (null where all are null).  No limit on partners, candidates or
lengths; an element is compared by a 64-bit fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.llm import filters
from insight.llm.base import documents, inner, landed, register
from insight.llm.words import GRAM, fingerprints, grams, in_row, mix, ragged, split_words, text_slices

#: counters of the sketch (4 bytes each, sent to every task) and its pieces
SKETCH = 1 << 20
PIECES = 64
#: classes that a rare element is guessed to meet besides its own
CHANCE = 0.05
#: postings of a cluster counted in one task
POSTINGS = 4_000_000
#: elements of the sets compared in one task
BLOCK = 1_000_000


def element_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets): the distinct elements of each text's set, sorted within the text."""
    w = split_words(column, lower=True)
    h = fingerprints(w)
    rows = len(w.first) - 1
    g = grams(h, n)
    inside = np.flatnonzero(in_row(w.first, n, len(g)))
    row = w.row[inside]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short) == 0:
        g = g[inside]
    else:
        # told apart from full-length elements by their number of words
        salt = mix(count[short].astype(np.uint64))
        whole = [grams(h[w.first[r]:w.first[r + 1]], int(count[r])) for r in short]
        g = np.concatenate([g[inside], mix(np.concatenate(whole) ^ salt)])
        row = np.concatenate([row, short.astype(row.dtype)])
        by = np.argsort(row, kind="stable")
        g, row = g[by], row[by]
    edge = np.searchsorted(row, np.arange(rows + 1))
    g = np.ascontiguousarray(g)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        g[a:b].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(rows + 1))


def classes(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 63-bit fingerprint of each whole set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(g ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    size = np.diff(first).astype(np.uint64)
    return (mix(total[first[1:]] - total[first[:-1]] + size * GRAM) >> np.uint64(1)).astype(np.int64)


def _survey(n: int):
    """Rows (doc_id, n_elements, class), and at the end of a task its sketch in pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for part in text_slices(batch, "text"):
                g, first = element_sets(part.column("text"), n)
                counts += np.bincount(g % np.uint64(SKETCH), minlength=SKETCH).astype(np.uint32)
                k = part.num_rows
                yield pa.record_batch(
                    [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(classes(g, first)),
                     pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["doc_id", "n", "cls", "piece", "counts"])
        none = pa.nulls(PIECES, pa.int64())
        yield pa.record_batch([none, none, none, pa.array(range(PIECES), pa.int32()),
                               pa.array([x.tobytes() for x in np.split(counts, PIECES)], pa.binary())],
                              names=["doc_id", "n", "cls", "piece", "counts"])
    return run


def sketch(surveyed: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches: added up inside each reading task, then by piece; ``SKETCH`` counters in all."""
    pieces = surveyed.filter("piece IS NOT NULL").select("piece", "counts").rdd \
        .map(lambda r: (r.piece, np.frombuffer(r.counts, np.uint32))) \
        .reduceByKey(lambda a, b: a + b).collect()
    out = np.zeros((PIECES, SKETCH // PIECES), np.uint32)
    for piece, counts in pieces:
        out[piece] = counts
    return out.ravel()


def prefixes(g: np.ndarray, first: np.ndarray, estimate: np.ndarray, noise: float, t: float
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into g, row, matches asked for) of each row's prefix, its length chosen by estimated cost."""
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    often = np.maximum(estimate[(g % np.uint64(SKETCH)).astype(np.int64)].astype(np.float64) - noise, 0.0)
    # the global order: rare elements first, equally rare ones by hash
    key = (np.minimum(often, 65535).astype(np.uint64) << np.uint64(48)) | (mix(g) >> np.uint64(16))
    by = np.empty(len(g), np.int64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        by[a:b] = a + np.argsort(key[a:b], kind="stable")
    need = np.ceil(t * size - 1e-9).astype(np.int64)
    base = size - need  # a prefix asking for m matches has base + m elements
    until = np.concatenate([[0.0], np.cumsum(often[by] + CHANCE)])
    best, asked = np.full(len(size), np.inf), np.ones(len(size), np.int64)
    m = 1
    while m <= need.max(initial=1):
        end = np.minimum(first[:-1] + base + m, first[1:])
        met = until[end] - until[first[:-1]]  # classes met along the prefix; at most met / m share m elements
        cost = (base + m) + met / m * size
        better = ((m <= need) | (m == 1)) & (cost < best)
        best[better], asked[better] = cost[better], m
        m *= 2
    length = np.where(size > 0, np.minimum(base + asked, size), 0)
    position = np.arange(len(g)) - np.repeat(first[:-1], size)
    take = position < np.repeat(length, size)
    return by[take], row[take], asked


def _postings(n: int, t: float, estimate: np.ndarray):
    # counters of rare elements hold others too: what lies within three deviations of the load is noise
    load = float(np.mean(estimate))
    noise = load + 3 * load ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in text_slices(batch, "text"):
                g, first = element_sets(part.column("text"), n)
                cls = classes(g, first)
                at, row, asked = prefixes(g, first, estimate, noise, t)
                new = np.zeros(len(cls), bool)  # a task sends each class once
                for r, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        new[r] = True
                at, row = at[new[row]], row[new[row]]
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.record_batch([pa.array(g[at].view(np.int64)), pa.array(cls[row]), pa.array(np.diff(first)[row].astype(np.int32)),
                                       pa.array(asked[row].astype(np.int32))], names=["element", "cls", "n", "asked"])
    return run


def size_bands(t: float, most: int) -> np.ndarray:
    """Lower ends of bands of sizes such that sets that can link are in one band or in neighbouring ones."""
    ends = [1]
    while ends[-1] <= most:
        ends.append(int(np.ceil((ends[-1] + (ends[-1] == 1)) / t - 1e-9)))
    return np.array(ends)


def _shared(t: float):
    """Of rows sorted by (element, n, cls): those whose element has other classes of near size.

    A run is one element in one band of sizes; its first class is its pivot.  The
    classes of a run meet at its pivot (``member`` is the class), and so do those
    of the next band (``member`` is the complement of the class, a negative
    number), so any two that can link meet at the pivot of the lower one's run.
    Lone classes are dropped.  A stream: it holds three rows.
    """
    names = ["element", "cls", "n", "asked"]
    bands = size_bands(t, 2**40)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # pivot of the run below, pivot and last row of the run at hand
        sent = False  # whether the pivot at hand has been sent
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = [batch.column(k).to_numpy() for k in names]
            old = len(held)
            if old:
                rows = [np.concatenate([np.array([h[k] for h in held], r.dtype), r]) for k, r in enumerate(rows)]
            distinct = np.ones(len(rows[0]), bool)
            distinct[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            distinct[:old] = True
            element, cls, n, asked = (r[distinct] for r in rows)
            band = np.searchsorted(bands, n, "right")
            start = np.ones(len(element), bool)
            start[1:] = (element[1:] != element[:-1]) | (band[1:] != band[:-1])
            head = np.flatnonzero(start)
            of = np.cumsum(start) - 1
            joins = (element[head[1:]] == element[head[:-1]]) & (band[head[1:]] == band[head[:-1]] + 1)
            below = np.append(-1, np.where(joins, head[:-1], -1))[of]
            has_more = np.diff(np.append(head, len(element))) > 1
            has_more[:-1] |= joins
            own = ~start
            own[head] = has_more
            upper = below >= 0
            if old:
                pivot_at = head[of[old - 1]]  # the pivot at hand is among the held rows
                own_pivot = own[pivot_at] and not sent
                own[:old] = False
                own[pivot_at] = own_pivot
                upper[:old] = False
                sent_before = sent
            last_head = head[-1]
            sent = bool(has_more[-1]) or bool(old and last_head == pivot_at and sent_before)
            below_last = below[last_head]
            keep = [*([below_last] if below_last >= 0 else []), last_head, *([len(element) - 1] if len(element) - 1 > last_head else [])]
            held = [[r[i].item() for r in (element, cls, n, asked)] for i in keep]
            pivot = cls[head[of]]
            yield pa.record_batch(
                [pa.array(np.concatenate([pivot[own], cls[below[upper]]])), pa.array(np.concatenate([element[own], element[upper]])),
                 pa.array(np.concatenate([cls[own], ~cls[upper]])), pa.array(np.concatenate([n[own], n[upper]])),
                 pa.array(np.concatenate([asked[own], asked[upper]]))], names=["pivot", "element", "member", "n", "asked"])
    return run


def core(met: DataFrame) -> DataFrame:
    """The (pivot, member) of ``met`` that can hold a link: a member must share as many elements as it, or some
    other of its groups, asks for.  What leaves lowers the counts of others; repeated until little leaves."""
    met, before = landed(met, "ngram-met"), None
    while True:
        n = met.count()
        if n == 0 or (before is not None and n > 0.95 * before):
            return met.select("pivot", "member")
        before = n
        groups = met.groupBy("pivot").agg(F.min("asked").alias("least"), F.count(F.lit(1)).alias("size"),
                                          F.max("member").alias("own")).filter("size > 1 AND own >= 0")
        open_ = met.join(groups, "pivot")
        enough = open_.groupBy("member").agg(F.sum("shared").alias("total"), F.min("least").alias("enough")) \
            .filter("total >= enough").select("member")
        met = landed(open_.drop("least", "size", "own").join(enough, "member").select("pivot", "member", "asked", "shared"), "ngram-met")


def _sets(n: int, wanted: np.ndarray):
    """(cls, set) of the rows whose doc_id may be wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(filters.let_through(batch.column("hash").to_numpy(), wanted)))
            for part in text_slices(some, "text"):
                g, first = element_sets(part.column("text"), n)
                cls = classes(g, first)
                yield pa.record_batch([pa.array(cls), pa.array(np.diff(first), pa.int64()), pa.array(
                    [g[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())],
                    names=["cls", "n", "elements"])
    return run


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def linked(sets: list[np.ndarray], side: np.ndarray, enough: Callable[[np.ndarray, int], np.ndarray]) -> list[tuple[int, int]]:
    """A forest of the links among ``sets``: enough of them to join all that links join.

    ``enough(common, x)`` tells which sets have enough elements in common with set
    ``x``.  ``side``: sets are compared across sides only (all sides equal: all with
    all).  The overlaps of one set are counted for all others at once, along an
    inverted list.  Pairs already joined need no count, so after one set has been
    compared, only those outside the largest component are.
    """
    n = len(sets)
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    by = np.argsort(everything, kind="stable")
    sorted_elements, owners = everything[by], owner[by]
    one_side = bool((side == side[0]).all())
    forest, out, done = Forest(n), [], np.zeros(n, bool)

    def compare(x: int) -> None:
        lo = np.searchsorted(sorted_elements, sets[x], "left")
        length = np.searchsorted(sorted_elements, sets[x], "right") - lo
        common = np.bincount(owners[ragged(lo, length)], minlength=n)
        ok = enough(common, x)
        ok[x] = False
        if not one_side:
            ok &= side != side[x]
        for y in np.flatnonzero(ok).tolist():
            if forest.join(x, y):
                out.append((x, y))
        done[x] = True

    compare(0)
    while True:
        root = np.array([forest.root(x) for x in range(n)])
        largest = np.bincount(root).argmax()
        rest = np.flatnonzero(~done & (root != largest))
        if len(rest) == 0:
            return out
        for x in rest[: max(1, len(rest) // 4)].tolist():
            compare(x)


def _refine(t: float):
    """Of one cluster's postings: the groups of members that share as many prefix elements as they ask for."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("member", kind="stable")
        member, first = np.unique(group["member"].to_numpy(), return_index=True)
        sets = np.split(group["element"].to_numpy(), first[1:])
        n, asked = group["n"].to_numpy()[first], group["asked"].to_numpy()[first]

        def enough(common, x):
            return (common >= np.minimum(asked, asked[x])) & (np.minimum(n, n[x]) >= t * np.maximum(n, n[x]) - 1e-9)

        forest = Forest(len(member))
        for x, y in linked(sets, np.zeros(len(member), int), enough):
            forest.join(x, y)
        root = np.array([forest.root(x) for x in range(len(member))])
        keep = np.bincount(root, minlength=len(member))[root] > 1
        return pd.DataFrame({"grp": member[root[keep]], "cls": np.where(member < 0, ~member, member)[keep]}, dtype="int64")
    return run


def _verify(percent: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("cls").sort_values("cls")
        cls = group["cls"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["elements"]]
        size = np.array([len(s) for s in sets])
        # blocks of one number meet inside, two different ones across
        side = np.zeros(len(cls), np.int64) if key[1] == key[2] else group["block"].to_numpy()

        def enough(common, x):
            return 100 * common >= percent * (size + size[x] - common)

        pairs = linked(sets, side, enough) if len(sets) > 1 else []
        return pd.DataFrame({"a": [cls[x] for x, _ in pairs], "b": [cls[y] for _, y in pairs]}, dtype="int64")
    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root): a node of its component that stands for each node with links (a, b); the same for all of them.

    Every round each node moves to the smallest node around it and on to that
    one's choice, and the links are drawn between the places moved to.  At least
    half of the places go in a round, so the links shrink fast; the rounds' moves
    are put together at the end.  Each round is written once.
    """
    links = landed(links.select("a", "b"), "links")  # used twice, and costly behind the set comparison
    edges = landed(links.union(links.select("b", "a")).filter("a != b").distinct(), "links")
    nodes = landed(links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), "nodes")
    moves = []
    while not edges.isEmpty():
        choice = landed(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "choices")
        onward = choice.select(F.col("a").alias("to"), F.col("to").alias("next"))
        move = landed(choice.join(onward, "to").select(F.col("a").alias("at"), F.col("next").alias("root")), "moves")
        moves.append(move)
        left = edges.join(move, edges["a"] == move["at"]).select(F.col("root").alias("a"), "b")
        both = left.join(move, left["b"] == move["at"]).select("a", F.col("root").alias("b"))
        edges = landed(both.filter("a != b").distinct(), "links")
    whole = None
    for move in reversed(moves):
        if whole is None:
            whole = move
        else:
            rest = whole.select(F.col("at").alias("root"), F.col("root").alias("end"))
            whole = move.join(rest, "root", "left").select("at", F.coalesce("end", "root").alias("root"))
    if whole is None:
        return nodes.select("node", F.col("node").alias("root"))
    return landed(nodes.join(whole, nodes["node"] == whole["at"], "left").select("node", F.coalesce("root", "node").alias("root")),
                  "components")


def join(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_elements, cls, component_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    surveyed = landed(rows.mapInArrow(_survey(n), "doc_id long, n long, cls long, piece int, counts binary"), "ngram-survey")
    estimate = sketch(surveyed)
    table = surveyed.filter("piece IS NULL").select("doc_id", "n", "cls")
    t = percent / 100

    postings = rows.mapInArrow(_postings(n, t, estimate), "element long, cls long, n int, asked int")
    shared = landed(postings.repartition("element").sortWithinPartitions("element", "n", "cls")
                    .mapInArrow(_shared(t), "pivot long, element long, member long, n int, asked int"), "ngram-shared")
    members = core(shared.groupBy("pivot", "member", "asked").agg(F.count(F.lit(1)).alias("shared")))
    # what postings join, directly or over others, is a cluster; inside it pairs are counted
    cluster = components(members.select(F.col("pivot").alias("a"), F.col("member").alias("b")))
    found = landed(shared.join(cluster.withColumnRenamed("node", "member"), "member"), "ngram-clusters")
    small = landed(found.groupBy("root").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") <= POSTINGS).select("root"),
                   "ngram-small")
    refined = found.join(small, "root", "left_semi").select("root", "element", "member", "n", "asked") \
        .groupBy("root").applyInPandas(_refine(t), "grp long, cls long")
    # a cluster beyond one task: whatever meets at a pivot is compared in that pivot's group
    own = F.when(F.col("member") < 0, F.bitwise_not("member")).otherwise(F.col("member"))
    wide = members.join(cluster.withColumnRenamed("node", "member"), "member").join(small, "root", "left_anti") \
        .select(F.col("pivot").alias("grp"), own.alias("cls")).distinct()
    groups = landed(refined.unionByName(wide), "ngram-groups")

    # the sets of these classes, once more from the text of one row of each
    reps = landed(table.join(groups.select("cls").distinct(), "cls", "left_semi")
                  .groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "ngram-reps")
    wanted = filters.build(reps, F.xxhash64("doc_id"))
    sets = rows.select(F.xxhash64("doc_id").alias("hash"), "text") \
        .mapInArrow(_sets(n, wanted), "cls long, n long, elements binary").dropDuplicates(["cls"])
    blocks = groups.join(reps.select("cls", "n"), "cls")
    weights = blocks.groupBy("grp").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size"))
    placed = blocks.join(weights.filter("size > 1"), "grp") \
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("grp", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "cls", "block")
    links = placed.join(sets.select("cls", "elements"), "cls").groupBy("grp", "one", "two") \
        .applyInPandas(_verify(percent), "a long, b long")
    labels = components(links)

    ids = table.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least")) \
        .join(labels.withColumnRenamed("node", "cls"), "cls", "left") \
        .withColumn("root", F.coalesce("root", "cls"))
    ids = landed(ids, "ngram-classes")
    named = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    named = landed(ids.select("cls", "root").join(named, "root").select("cls", "component_id"), "ngram-components")
    filled = table.filter("n > 0").join(named, "cls").select("doc_id", F.col("n").alias("n_elements"), "cls", "component_id")
    empty = table.filter("n = 0").select("doc_id", F.col("n").alias("n_elements"), "cls", F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty)


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of linked documents the one with the smallest doc_id.

    Documents without words and rows with a null doc_id all stay; rows repeating
    a doc_id stay or go together.
    """
    (id_,) = inner(docs, "join_id")
    holds = F.max(F.col("doc_id") == F.col("component_id"))
    drop = join(docs, n, percent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(holds.alias("holds")) \
        .filter("NOT holds").select(F.col("doc_id").alias(id_))
    return docs.join(drop, docs["doc_id"].cast("long") == F.col(id_), "left_anti").select(*[docs[c] for c in docs.columns])


@register("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).select("doc_id", F.col("n_elements").alias("n_shingles"), "component_id")

