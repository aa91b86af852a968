"""Nulls, empty tables, repeated rows and clashing names: defined results and no crash."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402
import corpus_pipeline  # noqa: E402

from eventlab.llm import hilbert, licenses, mixing, nearcopies, perplexity, quality, suffixes  # noqa: E402

N = len(cases.rows())


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark).repartition(3)


PER_DOCUMENT = {
    "near_duplicates": nearcopies.near_duplicates,
    "judge": quality.judge,
    "assign": hilbert.assign,
    "removed_spans": suffixes.removed_spans,
    "mix": mixing.mix,
    "licenses": lambda d: licenses.summary(licenses.scan(d)),
    "perplexity": lambda d: perplexity.classify(d, d.where("doc_id < 5").select("doc_id")),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(docs, name):
    assert PER_DOCUMENT[name](docs).count() == N


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_empty_table(spark, name):
    assert PER_DOCUMENT[name](cases.frame(spark, [])).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_rows(spark, docs, name, stage):
    out = stage(spark, docs, "")
    assert out.count() > 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert stage(spark, cases.frame(spark, []), "").count() == 0


def test_kept_rows_are_unchanged(spark, docs):
    everything = {tuple(r) for r in docs.collect()}
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_copies, corpus_pipeline.source_weights):
        assert {tuple(r) for r in stage(spark, docs, "").collect()} <= everything


def test_near_copies_keep_one_of_each_group(spark, docs):
    kept = corpus_pipeline.near_copies(spark, docs, "").collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(0) == 1 and 1 not in ids
    # Two texts share id 2: the near copy goes, the other one stays.
    assert [r.lang for r in kept if r.doc_id == 2] == ["es"]
    # Texts without words are alone; the two equal rows without an id leave one.
    assert {5, 6, 7} <= set(ids) and ids.count(None) == 1


def test_passages_are_cut_whole(spark, docs):
    out = {(r.doc_id, r.lang): r for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert out[1, "en"].text == ""
    assert cases.prose(2, 60) not in out[4, "de"].text and cases.prose(2, 60) in out[3, "de"].text
    assert out[5, None].text is None
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.values())
