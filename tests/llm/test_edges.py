"""Awkward and empty tables through every query and every pipeline stage."""

import corpus_pipeline
import edge_tables
import pytest

from pulsegrid.llm.queries import QUERIES
from pulsegrid.llm.store import read_table, stored

PER_DOCUMENT = [n for n in QUERIES if n.split("_")[0] not in ("op4", "op10", "op11", "op12", "op13")]


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_every_row_has_a_result(spark, edge_folder, name):
    rows = QUERIES[name](spark, edge_folder).collect()
    documents = edge_tables.documents()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((d[0] is None, d[0] or 0) for d in documents)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).collect() == []


def test_short_items_and_repeated_items(spark, edge_folder):
    rows = QUERIES["op4_decontamination"](spark, edge_folder).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(5, 4), (5, 4), (23, 1)]


def test_turns_without_text_role_or_key(spark, edge_folder):
    rows = QUERIES["op10_chat_format"](spark, edge_folder).collect()
    assert {r.conv_id for r in rows} == {1, 2, 3, None}
    assert sum(r.n_lines for r in rows) == 9


def test_vectors_without_label_or_component(spark, edge_folder):
    rows = QUERIES["op11_hard_negatives"](spark, edge_folder).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id) for r in rows) == sorted([(50, 3, 1, 1), (50, 3, 2, 2), (50, 50, 1, 1), (50, 50, 2, 2)] * 2)


def test_pipeline_stages(spark, edge_folder):
    docs = read_table(spark, edge_folder, "documents")
    schema = docs.schema
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, edge_folder), name)
        assert docs.columns == schema.names
        assert docs.select("score", "key", "row").distinct().count() <= 1  # clashing columns come through as they were
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None)
    assert not {0, 1, 2, 3, 15, 21, 22} & set(kept["language_id"]) and {4, 5, 9, 11} <= set(kept["language_id"])
    assert kept["ngram_jaccard_join"].count(11) == 1 and kept["ngram_jaccard_join"].count(4) == 1
    assert not {10, 12, 13} & set(kept["ngram_jaccard_join"]) and 9 in kept["ngram_jaccard_join"]
    leaks = {5, 23}  # document 5 is the two-word item, and another text of that id is not
    assert [i for i in kept["benchmark_decontamination"] if i not in leaks] == [i for i in kept["ngram_jaccard_join"] if i not in leaks]
    assert kept["benchmark_decontamination"].count(5) == 1 and 23 not in kept["benchmark_decontamination"]
    texts = {r.doc_id: (r.text, r.n_chars) for r in docs.select("doc_id", "text", "n_chars").collect()}
    assert texts[18][0] == '<secret>" end' and texts[18][1] == len(texts[18][0])
    final = corpus_pipeline.STAGES[-1][1](spark, docs, edge_folder)
    assert final.count() == docs.count()
