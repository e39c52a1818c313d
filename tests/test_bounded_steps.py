"""Work per row and memory per batch stay bounded: texts go through in slices,
a norm is computed once per vector."""
import numpy as np
import pandas as pd
import pyarrow as pa

from recsmith.functions import text as TX
from recsmith.functions import vectors as V
from recsmith.models import text_encoder as TE


def test_batches_of_texts_go_in_slices(monkeypatch):
    monkeypatch.setattr(TX, "CHARS_AT_ONCE", 40)
    texts = ["good day", None, "", "x" * 100, "not bad &amp; <b>great</b>"] * 20
    seen = []

    def fn(part: pd.Series) -> np.ndarray:
        seen.append(part.map(lambda x: len(x or "")).sum())
        return TX.text_features_batch(part, {"good": 1.9, "bad": -2.5, "great": 3.1}, frozenset(["not"]), {})["sentiment"].to_numpy()
    got = TX.in_slices(pa.array(texts, pa.string()), fn)
    whole = TX.text_features_batch(pd.Series(texts, dtype=object), {"good": 1.9, "bad": -2.5, "great": 3.1}, frozenset(["not"]), {})
    assert (got == whole["sentiment"].to_numpy()).all()
    assert len(seen) > 20 and max(seen) <= 40 + 100
    assert TX._cleaned(pa.array(texts, pa.string())).to_pylist() == [TX._clean_one(t) for t in texts]
    assert len(TX._cleaned(pa.array([], pa.string()))) == 0 and len(TX.in_slices(pa.array([], pa.string()), fn)) == 0


def test_clean_texts_equals_the_column_chain(spark):
    rows = [(i, t) for i, t in enumerate(["A &amp; b", "<p>x</p> y", None, "", "plain  text", "&lt;b&gt;", "a < b &copy"])]
    df = spark.createDataFrame(rows, "id int, t string")
    out = df.select(TX.clean_texts("t").alias("a"), TX.clean_html_text("t").alias("b")).collect()
    assert [r.a for r in out] == [r.b for r in out]


def test_encoder_by_text_equals_loops():
    rng = np.random.default_rng(1)
    weighted = rng.normal(size=(16, 4))
    lists = [rng.integers(0, 16, n).tolist() for n in (5, 0, 1, 40)] + [None]
    got = np.array(TE._encode_batch(pa.array(lists, pa.list_(pa.int64())), weighted).to_pylist())
    for b, v in zip(lists, got, strict=True):
        want = weighted[b].sum(axis=0) if b else np.zeros(4)
        assert np.allclose(v, want / max(np.linalg.norm(want), 1e-12), atol=1e-6)


def test_the_norm_is_not_inside_the_function_of_the_elements(spark):
    """64 elements cost 64 sums of squares before."""
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>")
    out = df.select(V.l2_normalize("v").alias("u"))
    assert [r.u for r in out.collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "/ greatest(" not in plan       # elements are divided by a bound value
