"""Ids that are null or -1, and columns with the names that operators use inside."""
from pyspark.sql import functions as F

from recsmith.llm import decontam, html_extract, langid, minhash

PROSE = "the quick brown fox jumps over the lazy dog near the river bank and runs away from the big bear"


def test_null_and_minus_one_are_different_ids(spark):
    rows = [(None, PROSE, "a"), (-1, PROSE, "b"), (-1, PROSE, "b"), (None, "no copy of anything else in this table at all", "c"),
            (-1, "another text that has no copy in this table", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tag string")
    kept = minhash.deduplicate(docs).collect()
    assert sorted(r.text for r in kept) == sorted({t for _, t, _ in rows})
    assert [r.doc_id for r in kept if r.text == PROSE] == [None]
    found = minhash.classes(docs)
    assert sorted(r.n_class for r in found.collect()) == [1, 1, 3, 3, 3]


def test_clashing_names(spark, docs):
    names = ["_minhash_id", "_minhash_key", "_decontam_id", "_decontam_key", "key", "uid", "_id", "_key", "item_id", "representative"]
    more = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    kept = minhash.deduplicate(more)
    assert kept.columns == more.columns and kept.count() == minhash.deduplicate(docs).count()
    items = spark.createDataFrame([(1, PROSE)], "item_id bigint, text string")
    clean = decontam.drop_contaminated(more, items)
    assert clean.columns == more.columns and clean.count() == decontam.drop_contaminated(docs, items).count()


def test_number_signs_are_no_letters():
    for text in ("\u00bd \u00b2", "\u2167", "\u2460 12 _", "", None, "\u0663"):
        assert not langid.has_letter(text)
    for text in ("\u00bd a", "\u2167\u00e9", "\u65e5", "_x", "1\u02b0"):
        assert langid.has_letter(text)


def test_deep_page_with_unmatched_end_tags():
    """End tags without an open element cost no search of the open ones."""
    import time
    page = "<div>" * 20_000 + "</p>" * 20_000 + "<p>text"
    begin = time.perf_counter()
    nodes = html_extract.parse(page)
    assert time.perf_counter() - begin < 5
    assert sum(n.tag == "div" for n in nodes) == 20_000 and [n.text for n in nodes if n.text] == ["text"]
    begin = time.perf_counter()
    html_extract.parse("<ul>" + "<div>" * 10_000 + "<p></ul></span></i>" * 5_000 + "<li>" * 5_000)
    assert time.perf_counter() - begin < 10
