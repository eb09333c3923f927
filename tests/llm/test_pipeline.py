import corpus_pipeline
from recon.llm.common import table
from recon.llm.naming import exact_groups
from recon.plans.lineage import materialize
from tests.llm.test_bottomk import brute

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, labels = docs.columns, {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), name.replace(" ", "-")))
    assert all(k.columns == columns for k in kept[:-1])
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept[:-1]]

    calm = set(ids[1])
    assert sum(labels.get(i) == 1 for i in calm) <= 0.5 * sum(t == 1 for t in labels.values())
    assert sum(labels.get(i) == 0 for i in calm) >= 0.95 * sum(t == 0 for t in labels.values())

    best = {}
    for r in kept[1].select("doc_id", "text").collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted(ids[2]) == sorted(best.values())
    assert exact_groups(kept[2]).where("NOT kept").count() == 0

    rows = sorted((r.doc_id, r.text) for r in kept[2].select("doc_id", "text").collect())
    want = [rows[i][0] for i, _, _, first in brute([t for _, t in rows], 5) if first]
    assert sorted(ids[3]) == want

    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in set(ids[4])) == 2
    words = {r.doc_id: len((r.text or "").encode().split()) for r in kept[3].select("doc_id", "text").collect()}
    assert abs(sum(words[i] for i in ids[4]) - 1.5 * sum(words.values())) < 0.02 * sum(words.values())

    pieces = kept[5].collect()
    assert {p.doc_id for p in pieces} == set(ids[4])
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)


def test_run_gives_the_last_stage(spark):
    df = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset"} <= set(df.columns) and df.count() > 0
