"""Packing: exact ids, every id in one piece, limits, gapless sequences."""
import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recsmith.llm.common import read_table
from recsmith.llm.packing import Limits, Packer, WordTokenizer, pack
from recsmith.llm.queries import word_bpe_path


@pytest.fixture(scope="module")
def tk():
    return WordTokenizer(word_bpe_path())


def reference_ids(tk, text):
    return tk.tk.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, texts, tk, limits=Limits()):
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for i, pieces in docs.items():
        ids, at = reference_ids(tk, texts[i]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            part = np.array(ids[p.start:p.start + p.length], dtype="<u4")
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(ids)
    total = padding = 0
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(p.loss_tokens for p in pieces) <= limits.loss
        total += at
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return total, padding


def test_ids_equal_the_tokenizer(tk):
    texts = ["İΣ ß Straße's don't 12½ \x1c á", "'s''ll x'y", "", "   ", "á combining", "日本語 text", "A" * 5000, "naïve café №5 — ok",
             "x\x85y\xa0z", "..!?..'re we'RE", "ſ ĳ Ǆ"]
    assert [np.frombuffer(b, tk.dtype).tolist() for b in tk.encode(texts)] == [reference_ids(tk, t)[:-1] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17f), st.sampled_from("abcde'st .,!?\n\t09éß½İ日")), max_size=40), max_size=5))
def test_ids_of_any_texts(texts):
    tk = _shared()
    assert [np.frombuffer(b, tk.dtype).tolist() for b in tk.encode(texts)] == [reference_ids(tk, t)[:-1] for t in texts]


@functools.cache
def _shared():
    return WordTokenizer(word_bpe_path(), keep=1 << 20)


def test_what_is_remembered_is_bounded():
    tk = WordTokenizer(word_bpe_path(), keep=3 << 20)
    for k in range(30):
        texts = [" ".join(f"q{k}x{i}z" for i in range(2000)), ""]
        assert [np.frombuffer(b, tk.dtype).tolist() for b in tk.encode(texts)] == [reference_ids(tk, t)[:-1] for t in texts]
        assert tk._size() < 6 << 20


def brute_pack(sizes, limits):
    """The packing of documents that are shorter than a sequence, by loops: [(document, start, end)] of each sequence."""
    waiting = [[d, 0, n, first] for d, (n, first) in enumerate(sizes)]
    loss_of = lambda s, e, first: max(0, e - max(s, first))
    out, lim = [], limits
    while waiting:
        left = sum(e - s for _, s, e, _ in waiting)
        if left < limits.tokens:
            lim = Limits(min(limits.tokens, 1 << (left.bit_length() - 1)), limits.segments, limits.loss)
        room, placed = [lim.tokens, lim.segments, lim.loss], []
        while room[0] and room[1] and waiting:
            best = None
            for i, (_, s, e, first) in enumerate(waiting):
                need = (e - s, 1, loss_of(s, e, first))
                if need[0] <= room[0] and need[2] <= room[2]:
                    score = ((room[0] / lim.tokens) * (need[0] / lim.tokens) + (room[1] / lim.segments) / lim.segments
                             + (room[2] / lim.loss) * (need[2] / lim.loss))
                    if best is None or score > best[0]:
                        best = (score, i)
            if best:
                d, s, e, first = waiting.pop(best[1])
            else:
                takes = [min(e - s, room[0], max(0, first - s) + room[2]) for _, s, e, first in waiting]
                i = max(range(len(waiting)), key=lambda i: (takes[i], -i))
                if takes[i] <= 0:
                    break
                d, s, e, first = waiting[i][0], waiting[i][1], waiting[i][1] + takes[i], waiting[i][3]
                waiting[i][1] = e
            placed.append((d, s, e))
            room = [room[0] - (e - s), room[1] - 1, room[2] - loss_of(s, e, first)]
        out.append(placed)
    return out


@pytest.mark.parametrize("limits", [Limits(64, 5, 64), Limits(64, 3, 30), Limits(32, 32, 32), Limits(50, 4, 7)])
def test_placement_by_loops(limits):
    rng = np.random.default_rng(limits.loss)
    sizes = [(int(n), int(f)) for n, f in zip(rng.integers(1, limits.tokens, 60), rng.integers(0, 20, 60), strict=True)]
    sizes = [(n, f) for n, f in sizes if n - f < limits.loss]          # no document fills a sequence on its own
    p = Packer(limits, pool=200)
    got = [s for k, (n, f) in enumerate(sizes) for s in p.add((k, b"", n, f))] + list(p.finish())
    assert [[(d[0], s, e) for d, s, e, _, _ in seq] for seq in got] == brute_pack(sizes, limits)


def test_documents(spark, sf, tk):
    docs = read_table(spark, sf, "documents")
    rows = pack(docs, word_bpe_path()).collect()
    total, padding = check(rows, {r.doc_id: r.text for r in docs.collect()}, tk)
    assert padding <= 0.01 * total


def test_edge_rows(spark, docs, no_docs, tk):
    rows = pack(docs, word_bpe_path()).collect()
    texts = docs.select("doc_id", "text").collect()
    assert sum(r.length for r in rows) == sum(len(reference_ids(tk, t.text)) for t in texts)
    assert {r.doc_id for r in rows} == {t.doc_id for t in texts}
    assert pack(no_docs, word_bpe_path()).collect() == []


def test_limits_of_loss_and_segments(spark, tk):
    rows = [(i, "word " * (3 + i * 7 % 60), i % 5) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, prompt bigint")
    limits = Limits(tokens=256, segments=6, loss=100)
    out = pack(docs, word_bpe_path(), limits, loss_from="prompt").collect()
    total, _ = check(out, {i: t for i, t, _ in rows}, tk, limits)
    by = {i: p for i, _, p in rows}
    assert sum(p.loss_tokens for p in out) == sum(max(0, len(reference_ids(tk, t)) - by[i]) for i, t, _ in rows)


def test_dot_product_rule():
    """Of the pieces that fit, the one with the largest dot product comes next; the first of equals."""
    p = Packer(Limits(tokens=10, segments=3, loss=10), pool=8)
    for k, n in enumerate((4, 6, 3, 6)):
        assert list(p.add((k, b"", n, 0))) == []
    first = p._one()
    assert [(d[0], s, e) for d, s, e, _, _ in first] == [(1, 0, 6), (0, 0, 4)]
