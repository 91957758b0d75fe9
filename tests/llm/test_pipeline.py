"""The registered queries and the pipeline on the smallest sample."""

import os
import re
from collections import Counter, defaultdict

import pytest
from messy_tables import SAMPLE

import corpus_pipeline
from repricer.llm.common import table, written
from repricer.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SAMPLE), reason="no sample tables")
COLUMNS = {
    "op1_": "doc_id piece start length ids_crc32 sequence_id offset",
    "op2_": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_": "page_id url text n_chars",
    "op4_": "doc_id held_out lang_pred score",
    "op5_": "doc_id severity p_toxic grade toxic",
    "op6_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_": "doc_id size source_size target taken",
    "op8_": "doc_id n_shingles component_id",
    "op9_": "doc_id n_words n_tokens",
    "op10_": "doc_id keep_id group_size kept text_sha256",
    "op11_": "query_id rank vec_id score",
    "op12_": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op13_": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SAMPLE)
    assert found.columns == COLUMNS[re.match(r"op\d+_", name)[0]].split()
    if name.startswith("op12_"):
        parts = {r[0] or "" for r in table(spark, SAMPLE, "documents").select("lang").distinct().collect()}
        assert Counter(r["part"] for r in found.collect()) == dict.fromkeys(parts, 600)
        return
    if name.startswith("op11_"):
        vectors = [r[0] for r in table(spark, SAMPLE, "embeddings").select("vec_id").collect()]
        assert Counter(r["query_id"] for r in found.collect()) == {i: 10 for i in vectors if i % 100 == 0}
        return
    ids = Counter(r[0] for r in found.select(found.columns[0]).collect())
    source = table(spark, SAMPLE, {"op3_": "pages", "op13_": "embeddings"}.get(re.match(r"op\d+_", name)[0], "documents"))
    assert set(ids) == {r[0] for r in source.select(source.columns[0]).collect()}
    assert name.startswith("op1_") or set(ids.values()) == {1}


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SAMPLE, "documents")
    columns = docs.columns
    rows = {"": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SAMPLE), name)
        rows[name] = docs.collect()
        assert docs.columns == columns or name == "best_fit_packing"
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    kept = defaultdict(int)
    for r in rows["language_id"]:
        kept[lower(r["text"])] = max(kept[lower(r["text"])], r["doc_id"])
    assert Counter(r["doc_id"] for r in rows["exact_dedup"]) == Counter(kept.values())
    sets = {}
    for r in rows["exact_dedup"]:
        words = lower(r["text"]).split()
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    lead = {i: i for i in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and 5 * (n := len(sets[a] & sets[b])) >= 4 * (len(sets[a]) + len(sets[b]) - n):
                low, high = sorted((find(a), find(b)))
                lead[high] = low
    assert {r["doc_id"] for r in rows["ngram_jaccard"]} == {find(i) for i in ids}
    assert Counter(r["doc_id"] for r in rows["source_mixing"]) <= Counter({i: 3 for i in {find(i) for i in ids}})
    firsts = Counter(r["doc_id"] for r in rows["best_fit_packing"] if r["piece"] == 0)
    assert firsts == Counter(r["doc_id"] for r in rows["source_mixing"])
