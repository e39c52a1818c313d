"""Near-duplicates by DartMinHash signatures and banded joining.

A document is its set of five-word shingles, each with a weight (1 unless the
caller gives another rule). Every element owns a region, its weight by an
endless time axis, and hashed darts fall on it as a Poisson process: cells of
the weight axis ([0,1), [1,2), [2,4), ...) each have their own stream of dart
times, all derived from hashes of the element. A document throws the darts of
its elements up to the time at which about k(ln k + 5) of them land inside its
weights, spreads them over k coordinates and keeps the earliest of each; the
work is the number of elements plus k ln k, whatever k is. Two documents agree
in a coordinate with the probability of their weighted Jaccard similarity.

Candidates share all ROWS coordinates of one of BANDS bands. They are compared
by the exact similarity of their shingle sets, and documents linked by 0.8 or
more form a class. Exact copies are folded first (one representative text of
each word sequence moves on). A band bucket is first compared to its smallest
document (a star: as many pairs as members). Buckets whose members then still
belong to several classes are compared whole, in blocks of bounded rows: inside
a task only pairs of different classes whose signatures agree well enough are
compared, and only links leave it. So no list of all pairs is ever written, a
bucket of any size is split over tasks, and no link between different classes of
a bucket is skipped.

A pair of similarity 0.8 shares a bucket with probability 1 - (1 - 0.8^4)^24 >
0.99999; the signature check before a comparison asks for 0.64, four standard
deviations under 0.8.

Words are runs of non-space characters, lower-cased. Texts under five words are
one shingle; a null text or one without words is a class of its own. Repeated
rows are exact copies; a null id sorts first and takes part like any other.
Ties do not occur: ids order documents, and rows that share an id and a text are
interchangeable. Other columns may have any names; an empty table gives an empty
table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsmith.llm.common import components, materialize, text_key, unused

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
AGREE = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / COORDINATES) ** 0.5
BLOCK_ROWS, BLOCK_SHINGLES = 1500, 3_000_000

_U = np.uint64
# fixed values: odd multipliers of 64-bit mixing
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = (x ^ (x >> _U(30))) * _M2
    x = (x ^ (x >> _U(27))) * _M3
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1) * 2.0 ** -53


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin."""
    words = [words_of(t) for t in texts]
    cut = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=cut[1:])
    flat = np.empty(cut[-1], object)
    flat[:] = [w for ws in words for w in ws]
    return pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, _U), cut


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of a text's word hashes, sorted."""
    n = len(h)
    if not n:
        return h
    size = min(size, n)
    s = np.zeros(n - size + 1, _U)
    for j in range(size):
        s = s * _M1 + h[j:n - size + 1 + j]
    return np.unique(mix(s + _U(size)))


def signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = COORDINATES) -> np.ndarray:
    """A row per set: for each coordinate the hash of the earliest dart inside
    the weights; zeros for an empty set."""
    out = np.zeros((len(sets), k), _U)
    size = np.array([len(s) for s in sets])
    if not size.sum():
        return out
    all_e, all_doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    all_w = np.concatenate([np.asarray(w, float) for w in weights]) if weights is not None else np.ones(len(all_e))
    total = np.bincount(all_doc, all_w, len(sets))
    todo = total > 0
    until = np.where(todo, k * (np.log(k) + 3) / np.where(todo, total, 1), 0)
    while todo.any():
        live = todo[all_doc] & (all_w > 0)
        e0, w0, doc0 = all_e[live], all_w[live], all_doc[live]
        places, times, darts = [], [], []
        low, width, cell = 0.0, 1.0, 0
        while len(e0):                       # cells of the weight axis
            doc, state, top, end = doc0, mix(e0 + _U((cell + 1) * int(_M1) & (2 ** 64 - 1))), w0, until[doc0]
            time = np.zeros(len(e0))
            while len(doc):                  # the next dart of every element that has one in time
                state = mix(state + _M1)
                time = time - np.log(unit(state)) / width
                on = np.flatnonzero(time <= end)
                doc, state, time, top, end = doc[on], state[on], time[on], top[on], end[on]
                dart = mix(state ^ _M2)
                hit = slice(None) if top.size and top.min() >= low + width else low + width * unit(mix(dart ^ _M3)) <= top
                darts.append(dart[hit])
                times.append(time[hit])
                places.append(doc[hit] * k + (dart[hit] % _U(k)).astype(np.int64))
            low, width, cell = low + width, (width if cell == 0 else width * 2), cell + 1
            deep = w0 > low
            e0, w0, doc0 = e0[deep], w0[deep], doc0[deep]
        at, t, d = np.concatenate(places), np.concatenate(times), np.concatenate(darts)
        order = np.argsort(-t, kind="stable")                # the earliest is written last
        found = np.zeros(len(sets) * k, bool)
        found[at] = True
        flat = out.reshape(-1)
        flat[at[order]] = d[order]
        todo = todo & ~found.reshape(len(sets), k).all(1)    # a coordinate without a dart: look further
        until = until * 2
    return out


def signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = COORDINATES) -> np.ndarray:
    return signatures([elements], None if weights is None else [weights], k)[0]


def bands_of(sig: np.ndarray) -> np.ndarray:
    """A key for each band, different bands apart."""
    key = np.arange(1, BANDS + 1, dtype=_U) * _M1
    for part in sig.reshape(BANDS, ROWS).T:
        key = mix(key * _M3 + part)
    return key


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))


def _copy_key(words: np.ndarray) -> bytes:
    """128-bit key of a word sequence."""
    places = mix(words + np.arange(1, len(words) + 1, dtype=_U) * _M1)
    return np.array([places.sum(dtype=_U) + _U(len(words)), np.bitwise_xor.reduce(mix(places + _M2))]).tobytes()


def fingerprints(rows: DataFrame) -> DataFrame:
    """doc_id, key, copy (a key of the whole word sequence; null without words),
    bands, of every row."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            copy, bands = [None] * len(texts), [None] * len(texts)
            for k in range(0, len(texts), 100):
                h, cut = word_hashes(texts[k:k + 100])
                own = [h[i:j] for i, j in zip(cut, cut[1:], strict=False)]
                for i, (words, sig) in enumerate(zip(own, signatures([shingles(w) for w in own]), strict=True), k):
                    if len(words):
                        copy[i] = _copy_key(words)
                        bands[i] = _signed(bands_of(sig))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(copy, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "copy", "bands"])

    return rows.mapInArrow(run, "doc_id bigint, key bigint, copy binary, bands array<bigint>")


def _sets(rows: DataFrame) -> DataFrame:
    """uid and the sorted shingles of (uid, text) rows, with the signature
    (low 16 bits of each coordinate)."""
    def run(batches):
        for batch in batches:
            h, cut = word_hashes(batch.column("text").to_pylist())
            sets = [shingles(h[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
            sigs = [x for k in range(0, len(sets), 100) for x in signatures(sets[k:k + 100])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), pa.array([_signed(np.sort(s)) for s in sets], pa.list_(pa.int64())),
                 pa.array([(x & _U(0xFFFF)).astype("<u2").tobytes() for x in sigs], pa.binary())],
                names=["uid", "shingles", "sig"])

    return rows.mapInArrow(run, "uid bigint, shingles array<bigint>, sig binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _star_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose similarity is large enough."""
    side = lambda c: sets.select(F.col("uid").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    total = F.size("a_set") + F.size("b_set") - common
    return both.filter(common >= F.lit(similarity) * total).select("a", "b")


def _block_links(similarity: float):
    """Links between the classes of a bucket block, for applyInPandas."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", kind="stable").drop_duplicates("uid")
        sig = np.stack([np.frombuffer(s, "<u2") for s in rows.sig])
        sets = [np.asarray(s) for s in rows.shingles]
        size = np.array([len(s) for s in sets])
        uid, kind, block = rows.uid.to_numpy(), pd.factorize(rows["root"])[0], rows.block.to_numpy()
        parent = list(range(kind.max() + 1))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        pair = rows.other.iloc[0] != rows.mine.iloc[0]      # two blocks against each other, or one inside itself
        for i in range(len(uid)):
            js = np.arange(i)
            if pair:
                js = js[block[js] != block[i]]
            js = js[(kind[js] != kind[i]) & (np.minimum(size[js], size[i]) >= similarity * np.maximum(size[js], size[i]))]
            if not len(js):
                continue
            agree = (sig[js] == sig[i]).mean(1)
            for o in np.argsort(-agree, kind="stable"):
                if agree[o] < AGREE:
                    break
                j = js[o]
                x, y = find(kind[i]), find(kind[j])
                if x != y and jaccard(sets[i], sets[j]) >= similarity:
                    parent[x] = y
                    links.append((uid[i], uid[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, class_id, n_class, representative of every row of ``docs``.

    class_id is the smallest doc_id of the class (null only if that row's id is
    null); the representative is the row, by (doc_id, key), that stays.
    """
    rows = _keyed(docs, id_col, text_col)
    marks = materialize(fingerprints(rows), "minhash-signatures")
    # one document stands for all with the same words; uid numbers the texts
    order = F.struct(F.col("doc_id").alias("id"), F.col("key").alias("key"))
    texts = (marks.filter("copy is not null").groupBy("copy")
             .agg(F.min(order).alias("lead"), F.first("bands").alias("bands")))
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("uid"), "copy", "lead", "bands"), "minhash-texts")

    # buckets with two texts or more, and their smallest text
    members = texts.select("uid", F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("uid").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = materialize(members.join(heads, "bucket"), "minhash-buckets")
    some = members.select("uid").distinct()
    leads = texts.join(some, "uid").select("uid", F.col("lead.id").alias("doc_id"), F.col("lead.key").alias("key"))
    sets = materialize(_sets(_texts_of(rows, leads)), "minhash-sets")

    pairs = members.filter("uid != head").select(F.col("head").alias("a"), F.col("uid").alias("b")).distinct()
    links = materialize(_star_links(pairs, sets, similarity), "minhash-links")
    roots = materialize(components(links), "minhash-roots")

    # buckets that still hold several classes, whole and in blocks
    own = members.select("bucket", "uid").join(roots.withColumnRenamed("id", "uid"), "uid", "left").select(
        "bucket", "uid", F.coalesce("root", "uid").alias("root"))
    size = own.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    size = size.filter("lo < hi").select("bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    mixed = (own.join(size, "bucket").join(sets.select("uid", F.size("shingles").alias("n_set")), "uid"))
    weight = mixed.groupBy("bucket").agg(F.greatest(F.max("blocks"), F.ceil(F.sum("n_set") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    mixed = mixed.drop("blocks", "n_set").join(weight, "bucket").withColumn(
        "block", F.pmod(F.xxhash64("uid", F.lit(11)), F.col("parts")).cast("int"))
    # each row goes to the tasks (its block, every block); mine <= other
    spread = mixed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "bucket", "uid", "root", "block", F.least("block", "with").alias("mine"), F.greatest("block", "with").alias("other"))
    more = (spread.join(sets, "uid").groupBy("bucket", "mine", "other")
            .applyInPandas(_block_links(similarity), "a bigint, b bigint"))
    links = materialize(links.unionByName(more).distinct(), "minhash-all-links")
    roots = materialize(components(links), "minhash-classes")

    # classes as (doc_id, key) of their smallest member
    found = texts.select("uid", "copy", "lead").join(roots.withColumnRenamed("id", "uid"), "uid", "left").select(
        "copy", "lead", F.coalesce("root", "uid").alias("root"))
    best = found.groupBy("root").agg(F.min("lead").alias("best"))
    found = found.join(best, "root").select("copy", "root", "best")
    member = marks.select("doc_id", "key", "copy").join(found, "copy", "left")
    sizes = marks.filter("copy is not null").groupBy("copy").count().join(found, "copy").groupBy("root").agg(F.sum("count").alias("n_class"))
    member = member.join(sizes, "root", "left")
    alone = F.col("best").isNull()
    return member.select(
        "doc_id", "key", F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("class_id"),
        F.coalesce("n_class", F.lit(1).cast("long")).alias("n_class"),
        (alone | (F.col("best.id").eqNullSafe(F.col("doc_id")) & (F.col("best.key") == F.col("key")))).alias("representative"))


def _texts_of(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """uid, text of the given (doc_id, key) pairs."""
    near = leads.select("uid", F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    both = rows.join(near, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["key"] == F.col("_key")))
    return both.select("uid", "text")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that represent their class, all columns. Of rows that
    share an id and a text one stays. The texts move once, joined to the narrow
    list of rows that go."""
    found = materialize(classes(docs, similarity, id_col, text_col), "minhash-members")
    id_name, key_name = unused(docs, "_minhash_id", "_minhash_key")
    key = [F.col("doc_id").alias(id_name), F.col("key").alias(key_name)]
    gone = found.filter(~F.col("representative")).select(*key)
    again = materialize(found.filter("representative and n_class > 1").groupBy(*key).count().filter("count > 1").drop("count"), "minhash-repeated")

    def mine(d: DataFrame) -> Column:
        return d[f"`{id_col}`"].cast("long").eqNullSafe(F.col(id_name)) & (text_key(d[f"`{text_col}`"]) == F.col(key_name))

    if again.isEmpty():
        return docs.join(gone.distinct(), mine(docs), "left_anti")
    out = docs.join(gone.unionByName(again).distinct(), mine(docs), "left_anti")
    twice = docs.join(again, mine(docs), "left_semi")
    first = [F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns if c not in (id_col, text_col)]
    one = twice.groupBy(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).agg(*first) if first else twice.distinct()
    return out.unionByName(one.select(*[F.col(f"`{c}`") for c in docs.columns]))
