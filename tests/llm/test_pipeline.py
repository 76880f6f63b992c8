"""The corpus pipeline against a plain version of its decisions."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    from weftlab.llm.words import shingle_sets
    from weftlab.session import materialise, table

    docs, seen = table(spark, SF, "documents"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        docs = materialise(stage(spark, docs, SF), "test-stage")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            seen[name] = (before, {r["doc_id"]: r["text"] for r in docs.collect()})
    good_in, good_out = seen["good_quality"]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert sum(i in good_out for i in good_in if labels.get(i) == 1) >= 0.95 * sum(labels.get(i) == 1 for i in good_in)
    before, after = seen["near_copies"]
    ids = sorted(before)
    sets = dict(zip(ids, (set(s.tolist()) for s in shingle_sets([before[i] for i in ids])), strict=True))
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert set(after) == {i for i in ids if root(i) == i}
    assert set(seen["without_secrets"][0]) == set(seen["without_secrets"][1])
    assert not any('token = "' in t and "<SECRET>" not in t for t in seen["without_secrets"][1].values() if t)
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    mixed_in, mixed_out = seen["mixed"]
    clean = [i for i in mixed_in if toxic.get(i) == 0]
    assert sum(i in mixed_out for i in clean) >= 0.97 * len(clean)
    assert {r["doc_id"] for r in docs.collect()} == set(mixed_out)
