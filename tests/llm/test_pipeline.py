import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_stages_and_result(spark):
    import corpus_pipeline as cp
    from brambling.llm import minhash, packing, toxicity
    from brambling.llm.common import documents, labels, stored

    docs = documents(spark, SMALL)
    columns = docs.columns
    # toxicity: what stays is what the operator does not predict
    clean = stored(cp.STAGES[0][1](spark, docs, SMALL), "t")
    gone = {r["doc_id"] for r in toxicity.toxicity(docs, labels(spark, SMALL)).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - gone and clean.columns == columns
    # one document of each class stays
    single = stored(cp.STAGES[1][1](spark, clean, SMALL), "t")
    assert {r["doc_id"] for r in single.collect()} == {r["doc_id"] for r in minhash.near_duplicates(clean).filter("kept").collect()}
    safe = stored(cp.STAGES[2][1](spark, single, SMALL), "t")
    assert safe.count() == single.count() and safe.columns == columns and not safe.filter("text rlike '[a-z0-9]@mail[0-9]'").count()
    mixed = stored(cp.STAGES[3][1](spark, safe, SMALL), "t")
    packed = cp.STAGES[4][1](spark, mixed, SMALL)
    assert mixed.columns == columns and packed.agg({"length": "sum"}).collect()[0][0] == packing.pieces(mixed).agg({"length": "sum"}).collect()[0][0]
