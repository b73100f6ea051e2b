"""Exact dedup against a persistent digest index (DataFrame functions only).

The index is a Parquet table bucketed and sorted by SHA-256 digest, one row for
each distinct text ever appended: ``(digest, holder)``.  A batch is reduced to
one row for each digest (partial aggregation, so a group of copies of any size
leaves each map task as one row), matched with the index by a sort-merge
anti-join that needs no shuffle of the index, and the digests not yet known are
appended to it.

Defined results: null text counts as empty, so null and empty texts are copies
of each other.  Among equal texts of a batch the largest doc_id holds; a null
doc_id holds only where every copy has a null one.  A text whose digest an
earlier batch has appended keeps that batch's holder.  Rows repeating both
doc_id and text share one decision in :func:`decide`; :func:`deduplicate` keeps
one of them.  Appending a batch again gives the same decisions, so a job that
died after its append can be rerun.  An empty table gives no rows; texts of any
length are digested whole.  Other columns pass through unread, whatever their
names (those of the documents table excepted).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.llm.base import documents, inner, landed, lower_az, register
from insight.session import scratch_path
from insight.sources.bucketed import BucketedTable


class DigestIndex(BucketedTable):
    """Bucketed digest table at ``path`` (shared storage), kept between runs.

    The number of buckets is stored with it when it is first made: choose it so
    that a bucket of the grown index fits a task (about 40 bytes a digest).  Later
    openings read it; another number is refused.  Every append adds a file to a
    bucket; ``compact`` makes one sorted file of them again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        super().__init__(spark, path, "digest binary, holder bigint", ["digest"], buckets)

    def append(self, groups: DataFrame) -> None:
        """Add the digests of ``groups`` (digest, holder; one row a digest) that the index lacks."""
        super().append(groups.select("digest", "holder").join(self.read().hint("merge"), "digest", "left_anti"))


def decide(docs: DataFrame, index: DigestIndex, cut: int | None = None) -> DataFrame:
    """Append the batch ``docs`` (doc_id, text) to the index; one row for each input row:
    doc_id, digest, keep_id, group_size, kept.

    With ``cut`` it is appended in two: rows from that doc_id on, then the rows
    below it, of whose digests the anti-join drops those that the first have
    brought.  The decisions are the same."""
    digests = landed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(lower_az(F.col("text")).cast("binary"), 256)).alias("digest")), "digests")
    groups = digests.groupBy("digest").agg(F.max("doc_id").alias("holder"), F.count(F.lit(1)).alias("group_size"),
                                           *([F.max(F.when(F.col("doc_id") < cut, F.col("doc_id"))).alias("below")] if cut is not None else []))
    groups = landed(groups, "digest-groups")
    if cut is None:
        index.append(groups)
    else:
        index.append(groups.filter(F.col("holder") >= cut))
        index.append(groups.filter(F.col("below").isNotNull() | F.col("holder").isNull()).select("digest", F.col("below").alias("holder")))
    held = groups.select("digest", "group_size").join(index.read().hint("merge"), "digest")
    held = landed(held, "digest-holders")
    # both sides are plain scans: a digest with very many copies is split by the skew join
    return digests.join(held, "digest").select(
        "doc_id", "digest", F.col("holder").alias("keep_id"), "group_size",
        F.col("doc_id").eqNullSafe(F.col("holder")).alias("kept"))


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text new to the index."""
    (key,) = inner(docs, "row_key")

    def keyed(digest, doc_id):
        return F.concat_ws(":", F.hex(digest), doc_id.cast("long").cast("string")).alias(key)

    kept = decide(docs, index).filter("kept").select(keyed(F.col("digest"), F.col("doc_id")))
    digest = F.unhex(F.sha2(lower_az(F.col("text")).cast("binary"), 256))
    # keyed by text and id: no two rows share a key unless they repeat each other
    return (docs.select("*", keyed(digest, F.col("doc_id"))).join(kept, key, "left_semi")
            .dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns]))


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index below the shared checkpoint folder, sized by the session's partition count."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"))


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""


@register("op1_exact_dedup", OP1_SQL)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    middle = docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).cast("long")).first()[0]
    rows = decide(docs, new_index(spark), middle)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
