"""The registered queries of this subpackage: importing the operators fills the catalogue."""

from insight.llm import (  # noqa: F401
    bpe,
    centroids,
    exact_dedup,
    language,
    mixing,
    ngram_join,
    pii,
    pitman_yor,
    quality,
    spelling,
    substring_dedup,
    toxicity,
    warc,
)
from insight.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
