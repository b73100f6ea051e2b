import random

import brute
import corpus_pipeline
import pytest

from insight.llm.base import DOCUMENT, documents


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "source_mixing", "bpe_round_trip"]


def test_stages_act_on_what_the_ones_before_kept(session, sf_dir, tmp_path):
    """Each stage against its plain version on its own input."""
    docs = documents(session, sf_dir)
    labels = {r.doc_id: r.toxic for r in session.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {(r.doc_id, r.text) for r in docs.collect()} if k < 4 else None
        stage(session, docs, sf_dir).write.parquet(path := f"{tmp_path}/{k}")
        docs_after = session.read.parquet(path)
        if k < 4:
            assert docs_after.columns == DOCUMENT
            kept[name] = [(r.doc_id, r.text) for r in docs_after.collect()]
            assert set(kept[name]) <= before
        if name == "toxicity":
            lost = {i for i, _ in before} - {i for i, _ in kept[name]}
            assert all(labels.get(i) != 0 for i in lost)
        if name == "exact_dedup":
            largest = {}
            for i, t in before:
                key = brute.lower_az(t or "")
                largest[key] = max(i, largest.get(key, i))
            assert {i for i, _ in kept[name]} == set(largest.values())
        if name == "ngram_jaccard_join":
            want = {i for i, (_, c) in brute.similar_components(list(before)).items() if i == c}
            assert {i for i, _ in kept[name]} == want
        if name == "bpe_round_trip":
            out = docs_after.collect()
            assert len(out) == len(kept["source_mixing"])
            texts = dict(kept["source_mixing"])
            assert all(r.decoded_sha256 == brute.sha256(texts[r.doc_id] or "") for r in out)
        docs = docs_after


def test_stages_take_empty_tables(session, make, sf_dir, tmp_path):
    docs = make([], extra=False)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(session, docs, sf_dir).write.parquet(path := f"{tmp_path}/{k}")
        docs = session.read.parquet(path)
        assert docs.count() == 0


@pytest.mark.parametrize("seed", [1])
def test_clean_documents_stay(session, seed):
    """Distinct plain documents lose nothing to the filtering stages."""
    r = random.Random(seed)
    rows = [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(120)), "en", "s", 0) for i in range(60)]
    docs = session.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(session, docs, "")
        assert docs.count() == 60, name
