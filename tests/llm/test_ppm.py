"""PPM: probabilities against a direct implementation with symbol exclusion; base scores against plain counts."""
import collections
import math
import zlib

import numpy as np
import pytest

from recsmith.llm import ppm
from recsmith.llm.common import read_table


class Direct:
    """Contexts in dictionaries, one symbol at a time."""

    def __init__(self, texts, order):
        self.order, self.seen = order, collections.defaultdict(collections.Counter)
        for t in texts:
            z = bytes([ppm.START]) * order + t + bytes([ppm.END])
            for i in range(order, len(z)):
                for o in range(order + 1):
                    self.seen[z[i - o:i]][z[i]] += 1

    def symbol(self, ctx, s):
        logp, off = 0.0, set()
        for o in range(self.order, -1, -1):
            c = self.seen.get(ctx[len(ctx) - o:])
            if not c:
                continue
            live = {k: v for k, v in c.items() if k not in off}
            n, d = sum(live.values()), len(live)
            if s in live:
                return logp + math.log10(live[s] / (n + d))
            if d:
                logp += math.log10(d / (n + d))
            off = set(c)
        return logp - math.log10(max(1, 256 - len(off)))

    def text(self, t):
        z = bytes([ppm.START]) * self.order + t + bytes([ppm.END])
        return sum(self.symbol(z[i - self.order:i], z[i]) for i in range(self.order, len(z)))


@pytest.fixture(scope="module")
def small(spark, sf):
    return read_table(spark, sf, "documents").filter("doc_id < 60")


def test_equal_to_direct(spark, small):
    train = [ppm.folded(r.text) for r in small.filter("doc_id < 30").collect()]
    _, model = ppm.train(small.filter("doc_id < 30").select("text"))
    d = Direct(train, ppm.ORDER)
    texts = [ppm.folded(r.text)[:400] for r in small.filter("doc_id >= 25").collect()] + [b"", b"q", "日本 zz\x00".encode(), train[0]]
    assert np.allclose(model.score(texts), [d.text(t) for t in texts], rtol=1e-6)


def test_probabilities_sum_to_one(spark, small):
    texts = [ppm.folded(r.text) for r in small.filter("doc_id < 10").collect()]
    _, model = ppm.train(small.filter("doc_id < 10").select("text"))
    for ctx in (texts[0][10:14], b"zzq\xc3", b"\xfe\xfe\xfe\xfe", texts[1][:4]):
        code = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256)], np.uint64)
        assert abs((10 ** model.log10(code)).sum() - 1) < 1e-6


def test_bounded_model(spark, small):
    """A bound cuts rare nodes; what is left still gives finite scores."""
    _, model = ppm.train(small.select("text"), max_nodes=500)
    assert all(len(c) <= 500 for c in model.codes.values()) and len(model.codes[4]) > 50
    s = model.score([ppm.folded(r.text) for r in small.collect()])
    assert np.isfinite(s).all() and (s < 0).all()


@pytest.mark.parametrize("head", [50, 1 << 20])
def test_base_scores(spark, sf, head):
    docs = read_table(spark, sf, "documents")
    texts = {r.doc_id: ppm.folded(r.text).split() + [None] for r in docs.collect()}
    c = collections.Counter()
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(w)
    n, room = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    rows = ppm.score(docs, head_words=head).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = texts[r.doc_id]
        want = sum(math.log10((c[x] + 0.1) / room) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - want) <= 1e-9 * abs(want) and r.score < 0
    held = [(r.score, len(texts[r.doc_id])) for r in rows if r.held_out]
    base = sum(r.base_score for r in rows if r.held_out)
    assert sum(s for s, _ in held) > base * 1.6      # bytes of known words cost little more than the words


def test_edge_rows(spark, docs, no_docs):
    rows = ppm.score(docs).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert ppm.score(no_docs).collect() == []
    held = docs.filter("doc_id = 8").select("doc_id", "text")
    only = held.filter(ppm.split_of(held.doc_id) == 0)
    for r in ppm.score(only).collect():             # no training text at all
        assert r.n_known == 0 and r.train_tokens == 0


@pytest.mark.parametrize("nodes", [0, 300, 1 << 20])
def test_cache_does_not_change_scores(spark, small, nodes):
    """Whatever the workers hold, scores are those of all counts."""
    docs = small.filter("doc_id < 24").selectExpr("doc_id", "left(text, 300) AS text")
    texts = {r.doc_id: ppm.folded(r.text) for r in docs.collect()}
    d = Direct([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10], ppm.ORDER)
    rows = ppm.score(docs, max_nodes=nodes).collect()
    assert len(rows) == len(texts) and any(r.held_out for r in rows)
    for r in rows:
        assert abs(r.score - d.text(texts[r.doc_id])) < 1e-6 * abs(r.score)
