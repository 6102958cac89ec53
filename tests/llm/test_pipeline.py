import re
from collections import Counter

import corpus_pipeline
from rows import edge_docs, no_docs
from test_data_operators import check_sequences

from ebbtide.llm import registry
from ebbtide.llm.simhash import fingerprint


def test_stages_one_after_another(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    start = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == start.columns, name
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in docs.collect()}
        texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in after.collect()]
        if name == "exact_dedup":
            before = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()}
            assert Counter(texts) == Counter(before)
        if name == "simhash_dedup":
            prints = [fingerprint(t) % (1 << 64) for t in texts]
            assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
        if name == "source_mixing":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect()}
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert check_sequences(packed) > 0
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in docs.collect())


def test_stages_bear_edge_rows(spark, folder, tmp_path):
    """Nulls, ties, repeated rows, clashing columns: each stage as its docstring says, columns untouched."""
    docs = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = [tuple(r) for r in docs.collect()]
        assert docs.columns == edge_docs(spark).columns and set(after) <= set(before), name
        if name == "quality_classifier":
            assert Counter(after) == Counter({r: n for r, n in Counter(before).items() if r in set(after)})
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in after]
            assert Counter(texts) == Counter({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in before})
        if name == "source_mixing":
            assert set(after) == set(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs(spark), folder).count() == 0


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in registry.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and len(corpus_pipeline.STAGES) == 5
    assert set(registry.ORACLE) <= set(registry.QUERIES)
