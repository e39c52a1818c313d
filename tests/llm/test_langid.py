"""Language ID: held-out accuracy, whole texts, edge rows."""
import numpy as np
from pyspark.sql import functions as F

from recsmith.llm import langid
from recsmith.llm.common import read_table


def test_held_out_accuracy(spark, sf):
    docs = read_table(spark, sf, "documents")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    acc = {r.held_out: r.a for r in out.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).collect()}
    assert acc[True] > 0.98 and acc[False] > 0.98
    assert out.filter("score < 0 or score > 1").isEmpty()


def test_tables_equal_the_convolution():
    """Tabulated filters give the network's own values."""
    net = langid.train([b"abc abd", b"xyz xyw"] * 4, ["a", "x"] * 4, epochs=1)
    x = langid.windows_of(bytes(range(1, 250)) * 3)
    h = []
    for w, table in zip(langid.WIDTHS, net.conv, strict=True):
        n = langid.WINDOW - w + 1
        h.append(sum(table[j][x[:, j:j + n]] for j in range(w)).max(1))
    z = np.maximum(np.concatenate(h, 1) + net.bias, 0) @ net.out + net.out_bias
    p = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(langid.Predictor(net).windows(x), p / p.sum(1, keepdims=True), atol=1e-5)


def test_whole_text_counts():
    """Windows after the first change the answer."""
    net = langid.train([b"aaab aab " * 40, b"zzzy zzy " * 40] * 8, ["a", "z"] * 8)
    p = langid.Predictor(net)
    assert p.texts(["aaab aab " * 30, "aaab aab " * 30 + "zzzy zzy " * 300])[0] == ["a", "z"]


def test_edge_rows(spark, docs, no_docs):
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id not in (None, 1)}
    for i in (3, 4, 5, 7):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert by[6].lang_pred in {"en", "de", "fr"}
    assert langid.identify(no_docs).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert docs.filter(langid.accepted(F.col("text"), langid.fit(unlabelled), 0.5)).count() == 8


def test_every_language_is_learned(spark):
    """More languages than 64, with null ids too; what tells them apart stands late in long texts."""
    names = [f"l{i:02}" for i in range(70)]
    rows = [(None if k < 3 else 100 * i + k, f"{chr(0x4E00 + 70 * i)}{chr(0x4E00 + 70 * i + 1)} " * 40, n) for i, n in enumerate(names)
            for k in range(12 if i < 69 else 4)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert net.langs == names
    same = "the same start of all texts " * 100
    late = [(i, same + ("aaab aab " if i % 2 else "zzzy zzy ") * 900, "a" if i % 2 else "z") for i in range(60)]
    net = langid.fit(spark.createDataFrame(late, "doc_id bigint, text string, lang string"))
    assert langid.Predictor(net).texts(["aaab aab " * 30, "zzzy zzy " * 30])[0] == ["a", "z"]
