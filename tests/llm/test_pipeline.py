"""The pipeline: each stage's rows against its operator, and edge rows through all of it."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from recsmith.llm import decontam, quality_rules
from recsmith.llm.common import read_table


def test_stages_take_effect(spark, sf):
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    kept = {r.doc_id for r in quality_rules.judge(docs, labels).filter("kept").collect()}
    a = P.quality(spark, docs, sf).cache()
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == kept and 0 < len(kept) < docs.count()
    b = P.language(spark, a, sf)
    assert b.columns == docs.columns and b.count() > 0.98 * len(kept)
    c = P.near_duplicates(spark, a, sf).cache()
    assert c.columns == docs.columns and c.select("text").distinct().count() == c.count() < len(kept)
    bad = {r.doc_id for r in decontam.contamination(c, read_table(spark, sf, "benchmark")).filter("contaminated").collect()}
    d = P.decontaminate(spark, c, sf)
    assert bad and {r.doc_id for r in d.collect()} == {r.doc_id for r in c.collect()} - bad
    a.unpersist()
    c.unpersist()


def test_run(spark, sf):
    rows = P.run(spark, sf).collect()
    assert [n for n, _ in P.STAGES] == ["quality", "language", "near_duplicates", "decontaminate", "pack"]
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert all(sum(p.length for p in ps) == ps[0].doc_tokens for ps in by.values()) and len(by) > 500


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_edge_rows(spark, docs, no_docs, sf, stage):
    out = stage(spark, docs, sf)
    assert out.count() <= docs.count() or stage is P.pack
    if stage is not P.pack:
        assert out.columns == docs.columns and out.join(docs, "doc_id", "left_anti").filter(F.col("doc_id").isNotNull()).isEmpty()
    assert stage(spark, no_docs, sf).collect() == []
