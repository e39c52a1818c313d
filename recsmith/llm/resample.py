"""Resampling towards a target distribution by importance weights.

Features of a text are its runs of 1 to ``longest`` words, hashed by CRC-32 into
buckets. The checksums of a batch's distinct features are computed together:
features of equal length in bytes form a matrix of uint8 (a row each), all
checksums of the matrix are updated column by column through the table of the
polynomial, and the results are scattered back to the features' places.

One pass over the documents counts the buckets (a row per bucket and task leaves
it), the target texts are counted likewise, and every bucket gets a whole-number
gain: the log ratio of its smoothed shares, in thousandths. A second pass sums
the gains of each document's features. Documents of enough words are drawn
without replacement by Gumbel noise from a hash of their id: the best scores win.
Ranks are positions in a range-partitioned sort, so no task holds all of them.

What reaches the driver is a row per bucket (``buckets`` at most).

Defined results: null text has no words, weight 0, and is never drawn; a null id
hashes as the empty string and sorts before all others; repeated rows count and
are ranked each (which of them comes first does not matter: they are alike); ties
of scores go to the smaller id; an empty table gives an empty table; an empty
target gives every bucket the gain of its smoothed share; other columns are
ignored, whatever their names; texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsmith.llm.common import materialize
from recsmith.operators.sequence import positions

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Words after which a batch's features are hashed and put down.
BATCH_WORDS = 500_000

_WORD = [c >= 128 or chr(c).isalnum() for c in range(256)]
_CLASSES = bytes((c + 32 if 65 <= c <= 90 else c) if ok else 32 for c, ok in enumerate(_WORD))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and bytes of other characters."""
    return (text or b"").translate(_CLASSES).split()


def _table() -> np.ndarray:
    """Remainders of all bytes for the reflected CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _table()


def crc32s(features: list[bytes]) -> np.ndarray:
    """CRC-32 of every feature."""
    out = np.zeros(len(features), np.uint32)
    if not features:
        return out
    size = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order], prepend=-1))
    for i, j in zip(cut, [*cut[1:], len(order)], strict=True):
        at = order[i:j]
        n = int(size[at[0]])
        rows = np.frombuffer(b"".join([features[k] for k in at.tolist()]), np.uint8).reshape(len(at), n)
        crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for c in range(n):
            crc = _CRC[(crc ^ rows[:, c]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[at] = ~crc
    return out


def buckets_of(texts: list[bytes | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of all texts, where each text's begin, and the
    number of words of each text."""
    number: dict[bytes, int] = {}
    known = []
    n_words, cut = np.zeros(len(texts), np.int64), np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words = words_of(text)
        n_words[i] = len(words)
        total = 0
        for n in range(1, min(longest, len(words)) + 1):
            runs = words if n == 1 else [b" ".join(words[k:k + n]) for k in range(len(words) - n + 1)]
            known.append(np.array([number.setdefault(r, len(number)) for r in runs], np.int64))
            total += len(runs)
        cut[i + 1] = cut[i] + total
    of = (crc32s(list(number)) % np.uint32(buckets)).astype(np.int64)
    return of[np.concatenate(known)] if known else np.zeros(0, np.int64), cut, n_words


def _batches(column: pa.Array, longest: int, buckets: int):
    """(first row, buckets, cuts, words) of a column, a bounded number of bytes at a time."""
    size = np.cumsum(np.concatenate([[0], pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)])) if len(column) else np.zeros(1)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(size, size[i] + 6 * BATCH_WORDS, "right")) - 1)
        yield i, *buckets_of(column.slice(i, j - i).to_pylist(), longest, buckets)
        i = j


def bucket_counts(rows: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. ``rows``: text, as bytes."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, of, _, _ in _batches(batch.column("text"), longest, buckets):
                total += np.bincount(of, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    found = rows.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found.bucket.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of the smoothed shares, by bucket."""
    n, total_s, total_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (total_s + n)) / float((s + 1) * (total_t + n))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(rows: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of (doc_id, text) rows."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            for i, of, cut, n_words in _batches(batch.column("text"), longest, buckets):
                total = np.concatenate([[0], np.cumsum(gain[of])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, len(n_words)), pa.array(n_words), pa.array(np.diff(cut)),
                     pa.array(total[cut[1:]] - total[cut[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    wanted = bucket_counts(target.select(F.col(f"`{text_col}`").cast("binary").alias("text")), longest, buckets)
    weighed = weigh(rows, gains(bucket_counts(rows, longest, buckets), wanted), longest)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = materialize(weighed.select("*", (F.col("weight") + noise).alias("score")), "resample-scores")

    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = positions(able.select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("down")), ["down", "doc_id"], "rank", start=1)
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    keep = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least_words).select(*keep, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*keep, rank).unionByName(rest)


def drawn_rows(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """doc_id and rank of the drawn rows."""
    return resample(docs, target, **settings).filter("rank is not null").select("doc_id", "rank")
