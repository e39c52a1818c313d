"""Decontamination: every shared span is found, short items too; edge rows."""
import hashlib
import random
import re

from recsmith.llm.decontam import contamination, drop_contaminated


def brute(docs, items, span=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add("" if i is None else str(i))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(docs, items):
    return sorted((tuple(r)[:6] for r in contamination(docs, items).drop("_id", "_key").collect()), key=str)


def test_random_spans(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(12)] + ["É", "é", "Straße", "7"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 5, 12, 13, 14, 20, 40])))) for i in range(40)]
    items += [(99, items[10][1]), (None, "Only Here, item without an id"), (100, None)]
    docs = []
    for i in range(150):
        t = rng.choices(vocab + [f"x{k}" for k in range(40)], k=rng.choice([0, 3, 12, 13, 30, 80]))
        if rng.random() < 0.7:
            w = rng.choice(items)[1]
            w = (w or "").split()
            a = rng.randrange(len(w) + 1)
            t[len(t) // 2:len(t) // 2] = w[a:a + rng.choice([5, 12, 13, 14, 30])]
        docs.append((i, rng.choice([" ", ", ", "-"]).join(t).upper() if rng.random() < 0.3 and "Straße" not in t and "é" not in t else " ".join(t)))
    docs += [(500, "say only here item WITHOUT an id ok")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert got(d, b) == want
    kept = {r.doc_id for r in drop_contaminated(d, b).collect()}
    assert kept == {r[0] for r in want if not r[5]}


def test_edge_rows(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the river bank and runs"), (2, None), (3, "x")],
                                  "item_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs, items) == brute(rows, [(r.item_id, r.text) for r in items.collect()])
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1").collect()[0].text.startswith("another")
    assert contamination(no_docs, items).collect() == []
    none = spark.createDataFrame([], items.schema)
    assert not any(r.contaminated for r in contamination(docs, none).collect())
