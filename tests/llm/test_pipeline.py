"""The pipeline's stages, each on its own input, and as a whole."""

import corpus_pipeline
from lodestar.llm.queries import QUERIES, table
from lodestar.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.001"


def test_stages_give_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == first.columns and 0 < docs.count() <= before.count(), name
        texts = {r["doc_id"]: r["text"] for r in before.collect()}
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(kept) <= set(texts)
        if name == "line_dedup":
            assert len(kept) == len(texts) and any(kept[i] != texts[i] for i in kept)
        else:
            assert all(kept[i] == texts[i] for i in kept)
        if name == "near_dedup":
            # no two kept texts share 0.8 of their five-word shingles, and every text that went is like one that stayed
            sets = {i: frozenset(shingle_hashes((t or "").encode(), 5).tolist()) for i, t in texts.items()}
            like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
            ids = sorted(kept)
            assert not [(a, b) for a in ids for b in ids if a < b and like(sets[a], sets[b])]
            gone = set(texts) - set(kept)
            assert all(any(like(sets[g], sets[o]) for o in texts if o != g) for g in gone)


def test_stages_take_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_packs_what_is_kept(spark):
    out = corpus_pipeline.run(spark, SF)
    by = {}
    for r in out.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by and all(sum(n for _, n in places) <= 4096 for places in by.values())
    assert out.select("doc_id").distinct().count() < table(spark, SF, "documents").count()


def test_all_queries_are_registered():
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted([f"op{n}" for n in range(1, 11)] + ["pipeline"])
