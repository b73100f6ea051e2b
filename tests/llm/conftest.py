import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def session(spark):
    from insight.llm.base import importable

    importable(spark)
    return spark


@pytest.fixture(scope="session")
def make(session):
    """Documents of (doc_id, text) or (doc_id, text, source) rows, with clashing extra columns."""
    from pyspark.sql import functions as F

    def build(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = session.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("row_key", "digest", "cls", "n", "join_id", "mix_id", "words", "kept", "hash", "score"):
                df = df.withColumn(name, F.lit(1))
        return df

    return build


@pytest.fixture(scope="session")
def rows(spark, sf_dir):
    """(doc_id, text) of the small documents table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
