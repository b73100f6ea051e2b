"""Mixing sources to target weights (DataFrame functions only).

Every source is cut into blocks of whole documents by a hash of doc_id.  A
source's target is its share of the mix; blocks in the order of their own hash
fill it: ``r = target / size`` passes over all blocks, the last one broken off at
the document that comes nearest the target.  The block draws of all sources are
then dealt to the output shards by a splitting tree: each node halves its
shards, and a multivariate-hypergeometric draw (one without replacement from
the node's blocks) says how many draws of each source go left.  A leaf holds an
exact quota for each source, taken as disjoint stretches of the source's
permuted draws, and is shuffled locally.

Only block sums, source sums and the tree are small tables: at most
``max_blocks`` rows for each source.  A source that holds a third of all rows is
spread over all its blocks.

Defined results: null text has size 0; a null source is a source of its own and
the last; a document without words is in no draw; rows repeating a doc_id fall
in the same block and are drawn as rows of their own.  Sources whose sizes are
all 0 have target 0.  An empty table gives an empty mix.  Reruns agree, as every
choice is a hash of ids and the seed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from insight.llm.base import WORD, documents, inner, landed, register
from insight.operators.joins import join_dimension

#: weights of the sources in code-point order, repeating; share of all sizes; most passes over a document
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def digest(*parts: Column) -> Column:
    """A 60-bit number from md5 of the parts (any engine has md5)."""
    text = F.concat_ws("/", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs) -> also ``sid`` (rank by code point, null last) and ``target``.

    Targets fill like water: sources in the order of capacity over weight, each
    taking the smaller of its capacity (``most`` times its size) and its weight's
    part of what the sources before it left over.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    ranked = sizes.withColumn("sid", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    mix = share * F.sum("source_size").over(everything)
    left = mix - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = ranked.withColumn("level", left / weight_left).withColumn(
        "full", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level of the first source that stays below its capacity holds for all after it
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(everything)
    return filled.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level["level"] * F.col("weight"))) \
        .select("source", "source_size", "n_docs", "sid", "target")


def plan_mix(docs: DataFrame, seed: int = 0, block_docs: int = 16, max_blocks: int = 1024,
             weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): row (its own number), doc_id, source, size, sid,
    source_size, target, block, copies (times the mix takes it)."""
    sized = landed(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source",
        n_words(F.col("text")).alias("size")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = landed(source_targets(sizes, weights, share, most), "mix-targets")
    n_blocks = F.least(F.lit(max_blocks), F.ceil(F.col("n_docs") / block_docs)).cast("long")
    t = targets.select("sid", "source", "source_size", "target", n_blocks.alias("n_blocks")) \
        .withColumnRenamed("source", "named")
    rows = sized.join(t, sized["source"].eqNullSafe(t["named"])).drop("named")
    rows = rows.withColumn("block", digest(F.lit(seed), F.lit("block"), F.col("doc_id")) % F.col("n_blocks"))

    # full passes, and what the last, partial one must still take
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    blocks = rows.filter("size > 0").groupBy("sid", "block").agg(
        F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    order = Window.partitionBy("sid").orderBy(digest(F.lit(seed), F.lit("order"), F.col("sid"), F.col("block")), "block")
    blocks = blocks.withColumn("until", F.sum("words").over(order)) \
        .withColumn("passes", passes.cast("int")) \
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")) \
        .withColumn("rest_here", F.col("rest") - (F.col("until") - F.col("words"))) \
        .select("sid", "block", "passes", "words", "rest_here")
    rows = rows.join(blocks, ["sid", "block"], "left")
    whole = F.col("rest_here") >= F.col("words")
    cut = (F.col("rest_here") > 0) & ~whole
    # only the one block of a source where its target falls is ordered document by document
    inside = Window.partitionBy("sid", "block").orderBy(
        digest(F.lit(seed), F.lit("doc"), F.col("doc_id")), "doc_id", "size")
    keep = ["row", "doc_id", "source", "size", "sid", "source_size", "target", "block", "copies"]
    plain = rows.filter(~F.coalesce(cut, F.lit(False))).withColumn("copies", F.when(
        F.col("size") > 0, F.col("passes") + whole.cast("int")).otherwise(F.lit(0))).select(keep)
    edge = rows.filter(cut).withColumn("until", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + (
            F.col("until") - F.col("size") / 2 <= F.col("rest_here")).cast("int")).otherwise(F.lit(0))).select(keep)
    return plain.unionByName(edge)


def draw_left(node: Column, quotas: Column, go_left: Column, seed: int) -> Column:
    """How many of each source's draws a node sends left: ``go_left`` of all, without replacement.

    Selection sampling: block after block goes left with the chance
    ``still to send / still to see``, which draws the counts from the
    multivariate-hypergeometric law exactly.
    """
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(total.alias("see"), go_left.cast("long").alias("send"), F.array().cast("array<bigint>").alias("out"))

    def source(a, q):
        k = F.size(a["out"])
        one = F.struct(a["see"].alias("see"), a["send"].alias("send"), F.lit(0).cast("long").alias("n"))

        def block(b, i):
            u = F.pmod(F.xxhash64(F.lit(seed), node, k, i), F.lit(1 << 52)).cast("double") / float(1 << 52)
            hit = (u * b["see"] < b["send"]).cast("long")
            return F.struct((b["see"] - 1).alias("see"), (b["send"] - hit).alias("send"), (b["n"] + hit).alias("n"))

        steps = F.when(q > 0, F.sequence(F.lit(1).cast("long"), q)).otherwise(F.array().cast("array<bigint>"))
        drawn = F.aggregate(steps, one, block)
        return F.transform(F.array(drawn), lambda d: F.struct(
            d["see"].alias("see"), d["send"].alias("send"), F.concat(a["out"], F.array(d["n"])).alias("out")))[0]

    return F.aggregate(quotas, start, source, lambda a: a["out"])


def splitting_tree(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(sid, draws) -> (shard, sid, first, draws): each shard's exact quota, as a stretch of the source's draws."""
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("sid", "draws"))).alias("all")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("all.sid").alias("sids"),
        F.transform("all", lambda x: F.lit(0).cast("long")).alias("firsts"),
        F.col("all.draws").cast("array<bigint>").alias("quotas"))
    for _ in range(math.ceil(math.log2(max(shards, 1)))):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        share = F.floor(total * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        left = draw_left(F.hash("lo", "hi"), F.col("quotas"), share, seed)
        cut = node.withColumn("mid", mid).withColumn(
            "left", F.when(F.col("hi") - F.col("lo") > 1, left).otherwise(F.col("quotas")))
        halves = F.array(
            F.struct("lo", F.when(F.col("hi") - F.col("lo") > 1, F.col("mid")).otherwise(F.col("hi")).alias("hi"),
                     F.col("firsts"), F.col("left").alias("quotas")),
            F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("firsts", "left", lambda f, x: f + x).alias("firsts"),
                     F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")))
        halves = F.slice(halves, 1, F.when(F.col("hi") - F.col("lo") > 1, 2).otherwise(1))
        node = cut.select("sids", F.explode(halves).alias("h")).select("h.lo", "h.hi", "sids", "h.firsts", "h.quotas")
    return node.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("sids", "firsts", "quotas")).alias("x")).select(
        "shard", F.col("x.sids").alias("sid"), F.col("x.firsts").alias("first"), F.col("x.quotas").alias("draws")) \
        .filter("draws > 0")


def placements(plan: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(row, doc_id, source, size, pass, shard): each pass over each row of the (landed) plan, where the tree deals it."""
    taken = plan.filter("copies > 0")
    # one draw for each pass over a block; the draws of a source in the order of pass and block hash
    draws = taken.select("sid", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pass")).distinct()
    turn = Window.partitionBy("sid").orderBy("pass", digest(F.lit(seed), F.lit("order"), F.col("sid"), F.col("block")), "block")
    draws = landed(draws.withColumn("draw", F.row_number().over(turn) - 1), "mix-draws")
    tree = landed(splitting_tree(draws.groupBy("sid").agg(F.count(F.lit(1)).alias("draws")), shards, seed), "mix-tree")
    stretches = tree.withColumn("draw", F.explode(F.expr("sequence(first, first + draws - 1)"))).select("shard", "sid", "draw")
    placed = draws.withColumn("draw", F.col("draw").cast("long")).join(stretches, ["sid", "draw"]) \
        .select("sid", "block", "pass", "shard")
    return taken.select("row", "doc_id", "source", "size", "sid", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pass")) \
        .join(placed, ["sid", "block", "pass"]).select("row", "doc_id", "source", "size", "pass", "shard")


def in_shards(rows: DataFrame, shards: int, shard: Column, doc_id: Column, turn: Column, seed: int) -> DataFrame:
    """``rows`` by shard, shuffled inside each."""
    key = digest(F.lit(seed), F.lit("place"), doc_id, turn)
    return rows.repartition(shards, shard).sortWithinPartitions(shard, key, doc_id, turn)


def mix(docs: DataFrame, shards: int, seed: int = 0, **options) -> DataFrame:
    """The mixed rows of ``docs``, each as often as the mix takes it, in one partition for each shard and
    shuffled inside it; columns as in ``docs``."""
    id_, source_, size_, places_ = inner(docs, "mix_id", "mix_source", "mix_size", "mix_places")
    plan = landed(plan_mix(docs, seed, **options).filter("copies > 0"), "mix-plan")
    places = placements(plan, shards, seed) \
        .groupBy("doc_id", "source", "size").agg(F.collect_set(F.struct("pass", "shard")).alias("places"))
    places = landed(places.select(F.col("doc_id").alias(id_), F.col("source").alias(source_), F.col("size").alias(size_),
                                  F.col("places").alias(places_)), "mix-places")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & docs["source"].eqNullSafe(F.col(source_)) \
        & (n_words(docs["text"]) == F.col(size_))
    # sent to every task while it is small, else the documents are shuffled once more
    rows = join_dimension(docs, places, same, max_bytes=64 << 20).withColumn(places_, F.explode(places_))
    rows = rows.withColumn(size_, F.col(places_)["shard"])
    return in_shards(rows, shards, F.col(size_), F.col(id_), F.col(places_)["pass"], seed) \
        .select(*[docs[c] for c in docs.columns])


def taken_words(docs: DataFrame, shards: int, seed: int = 0, **options) -> DataFrame:
    """Every row of the plan with ``taken``: its words in the shuffled shards, 0 where the tree dealt it to none."""
    plan = landed(plan_mix(docs, seed, **options), "mix-plan")
    dealt = landed(in_shards(placements(plan, shards, seed), shards, F.col("shard"), F.col("doc_id"), F.col("pass"), seed)
                   .select("row", "size", "shard"), "mix-dealt")
    taken = dealt.groupBy("row").agg(F.sum("size").alias("taken"))
    return plan.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def op3_sql(seed: int = 0, block_docs: int = 16, max_blocks: int = 1024) -> str:
    def h(*parts: str) -> str:
        return f"('0x' || substr(md5(concat_ws('/', {', '.join(parts)})), 1, 15))::BIGINT"

    weight = f"list_extract([{', '.join(map(str, WEIGHTS))}], sid % {len(WEIGHTS)} + 1)"
    return rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1)::BIGINT AS sid
  FROM sized GROUP BY source),
-- rounds of sharing: what is above a capacity is shared anew among the others
fill AS (
  SELECT 0 AS round, sid, {weight}::DOUBLE AS weight, {MOST} * source_size AS cap, false AS capped FROM sources
  UNION ALL
  SELECT round + 1, sid, weight, cap,
         capped OR cap <= weight * ({SHARE} * total - taken) / open_weight
  FROM (SELECT *, sum(cap) OVER () / {MOST} AS total,
               coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0) AS taken,
               sum(weight) FILTER (WHERE NOT capped) OVER () AS open_weight FROM fill)
  WHERE round < (SELECT count(*) FROM sources)),
done AS (SELECT * FROM fill WHERE round = (SELECT max(round) FROM fill)),
targets AS (
  SELECT s.*, CASE WHEN d.capped THEN d.cap ELSE d.weight * ({SHARE} * (SELECT sum(source_size) FROM sources)
                - (SELECT coalesce(sum(cap), 0) FROM done WHERE capped)) / (SELECT sum(weight) FROM done WHERE NOT capped) END AS target,
         least({max_blocks}, ceil(n_docs / {block_docs}))::BIGINT AS n_blocks
  FROM sources s JOIN done d USING (sid)),
placed AS (
  SELECT z.doc_id, z.size, t.sid, t.source_size, t.target, {h(str(seed), "'block'", "z.doc_id")} % n_blocks AS block
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source),
blocks AS (
  SELECT sid, block, sum(size) AS words, any_value(target) - (CASE WHEN any_value(source_size) > 0
           THEN floor(any_value(target) / any_value(source_size)) ELSE 0 END) * any_value(source_size) AS rest,
         sum(sum(size)) OVER (PARTITION BY sid ORDER BY {h(str(seed), "'order'", "sid", "block")}, block) AS until
  FROM placed WHERE size > 0 GROUP BY sid, block),
docs AS (
  SELECT p.*, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes,
         rest - (until - words) AS rest_here, words,
         sum(size) OVER (PARTITION BY p.sid, p.block ORDER BY {h(str(seed), "'doc'", "doc_id")}, doc_id, size ROWS UNBOUNDED PRECEDING) AS inside
  FROM placed p LEFT JOIN blocks b ON p.sid = b.sid AND p.block = b.block)
SELECT doc_id, size::BIGINT AS size, source_size, round(target::DOUBLE, 6) AS target,
       (CASE WHEN size = 0 THEN 0
             WHEN rest_here >= words THEN passes + 1
             WHEN rest_here > 0 AND inside - size / 2 <= rest_here THEN passes + 1
             ELSE passes END * size)::BIGINT AS taken
FROM docs
"""


@register("op3_source_mixing", op3_sql())
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return taken_words(documents(spark, sf_dir), shards).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")
