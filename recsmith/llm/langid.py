"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of a window, a rectifier and the
maximum over the window keep one value per filter, and a softmax layer gives
the languages. It is trained in numpy on a bounded sample of labelled texts
and applied to every window of every text: windows have a fixed length and
cover the whole text, and the windows' probabilities are averaged.

A filter over one-hot bytes is a table lookup: filter values for byte pairs are
tabulated once per worker, so a width-4 filter costs two lookups.

Defined results: ``und`` with score 0 if the text is null or has no letter;
repeated rows get equal results; with no labelled text every text is ``und``;
of equally probable languages the first by name wins; texts of any length are
read whole, in groups of windows; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recsmith.llm.common import materialize

UNDETERMINED = "und"
WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
#: Bounds of the training sample: rows of a language, rows of all (but with very
#: many languages LEAST_ROWS of each), windows of a row.
ROWS_PER_LANG, TRAIN_ROWS, LEAST_ROWS, TRAIN_WINDOWS = 600, 38_400, 8, 8

_WORDLIKE = re.compile(r"[^\W\d_]+")


def has_letter(text: str | None) -> bool:
    r"""Whether a text has a letter (\p{L}): number signs such as ½, ² or Ⅷ are none."""
    return bool(text) and any(any(map(str.isalpha, m.group())) for m in _WORDLIKE.finditer(text))


def split_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 3; remainder 1 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


@dataclass
class Network:
    langs: list[str]
    conv: list[np.ndarray]          # for each width: (width, 256, filters)
    bias: np.ndarray                # (widths * filters,)
    out: np.ndarray                 # (widths * filters, langs)
    out_bias: np.ndarray


def windows_of(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text; the last one is filled with zero bytes."""
    n = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(n * size, b"\0"), dtype=np.uint8).reshape(n, size)


def train(texts: list[bytes], langs: list[str], epochs: int = 6, seed: int = 7, rate: float = 0.02,
          batch: int = 64, filters: int = FILTERS) -> Network:
    """Adam on the cross entropy of single windows, languages weighted alike."""
    names = sorted(set(langs))
    code = {k: i for i, k in enumerate(names)}
    rng = np.random.default_rng(seed)
    net = Network(names, [rng.normal(0, 0.3 / w, (w, 256, filters)).astype(np.float32) for w in WIDTHS],
                  np.zeros(len(WIDTHS) * filters, np.float32),
                  rng.normal(0, 0.1, (len(WIDTHS) * filters, len(names))).astype(np.float32),
                  np.zeros(len(names), np.float32))
    parts = [windows_of(t) for t in texts]
    x = np.concatenate(parts)
    y = np.repeat([code[k] for k in langs], [len(p) for p in parts])
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names))))[y].astype(np.float32)
    params = [*net.conv, net.bias, net.out, net.out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(order := rng.permutation(len(y)), max(1, len(order) // batch)):
            b = x[rows]
            peaks, where = [], []
            for w, table in zip(WIDTHS, net.conv, strict=True):
                n = WINDOW - w + 1
                act = sum(table[j][b[:, j:j + n]] for j in range(w))
                at = act.argmax(1)
                where.append(at)
                peaks.append(np.take_along_axis(act, at[:, None, :], 1)[:, 0])
            h = np.concatenate(peaks, 1) + net.bias
            on = h > 0
            h = np.where(on, h, 0)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            gz = p * weight[rows, None] / len(rows)
            gh = np.where(on, gz @ net.out.T, 0)
            grads = []
            for k, (w, at) in enumerate(zip(WIDTHS, where, strict=True)):
                part, g = gh[:, k * filters:(k + 1) * filters], []
                for j in range(w):
                    byte = np.take_along_axis(b, at + j, 1).astype(np.int64)
                    flat = byte * filters + np.arange(filters)
                    g.append(np.bincount(flat.ravel(), part.ravel(), 256 * filters).reshape(256, filters))
                grads.append(np.stack(g))
            grads += [gh.sum(0), h.T @ gz, gz.sum(0)]
            step += 1
            for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                q -= (rate * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


class Predictor:
    """The network with its filters tabulated over byte pairs."""

    BLOCK = 64                      # windows at a time: their values stay in cache

    def __init__(self, net: Network):
        self.net = net
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        t2, t3, t4 = net.conv
        self.t2, self.t3, self.t3b = pair(t2[0], t2[1]), pair(t3[0], t3[1]), t3[2]
        self.t4, self.t4b = pair(t4[0], t4[1]), pair(t4[2], t4[3])

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        out = np.empty((len(x), len(self.net.langs)), np.float32)
        for k in range(0, len(x), self.BLOCK):
            b = x[k:k + self.BLOCK]
            code = (b[:, :-1].astype(np.uint16) << 8) | b[:, 1:]
            v3 = self.t3[code[:, :-1]]
            v3 += self.t3b[b[:, 2:]]
            v4 = self.t4[code[:, :-2]]
            v4 += self.t4b[code[:, 2:]]
            h = np.concatenate([self.t2[code].max(1), v3.max(1), v4.max(1)], 1) + self.net.bias
            z = np.maximum(h, 0) @ self.net.out + self.net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            out[k:k + self.BLOCK] = p / p.sum(1, keepdims=True)
        return out

    def texts(self, texts: list[str | None], group: int = 1 << 22) -> tuple[list[str], list[float]]:
        lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if self.net.langs and has_letter(t)]
        k = 0
        while k < len(known):            # groups of about 4 MB of windows; one long text may be more
            parts, size, first = [], 0, k
            while k < len(known) and size < group:
                parts.append(windows_of(texts[known[k]].encode("utf-8", "surrogatepass")))
                size += parts[-1].size
                k += 1
            p = self.windows(np.concatenate(parts))
            cut = np.concatenate([[0], np.cumsum([len(q) for q in parts])[:-1]])
            mean = np.add.reduceat(p, cut, axis=0) / np.array([[len(q)] for q in parts])
            best = mean.argmax(1)
            for i, j, row in zip(known[first:k], best, mean, strict=True):
                lang[i], score[i] = self.net.langs[j], min(1.0, float(row[j]))
        return lang, score


def training_windows(text: Column, order: Column) -> Column:
    """The bytes of TRAIN_WINDOWS windows, one of each equal part of the text by
    a hash; of all windows if there are no more."""
    raw = F.encode(text, "UTF-8")
    n = F.ceil(F.octet_length(raw) / WINDOW).cast("long")
    part = lambda k: F.floor(n * k / TRAIN_WINDOWS).cast("long")
    picked = [part(k) + F.pmod(F.xxhash64(order, F.lit(k)), F.greatest(F.lit(1), part(k + 1) - part(k))) for k in range(TRAIN_WINDOWS)]
    return F.when(n <= TRAIN_WINDOWS, raw).otherwise(
        F.concat(*[F.substring(raw, (i * WINDOW + 1).cast("int"), F.lit(WINDOW)) for i in picked]))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", seed: int = 7) -> Network:
    """Trains on a sample of every language: about four times the rows that it
    may have by a hash of id and text, and of these those with the smallest
    hash. All languages have the same bound, lower if there are many."""
    order = F.xxhash64(F.col("id").cast("string"), F.col("text"), F.lit(seed))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"),
                       F.col(f"`{text_col}`").alias("text")).filter(
        (split_of(F.col("id")) != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("order", order).withColumn("place", F.pmod("order", F.lit(1_000_003)))
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("first")), "lang-counts")
    most = min(ROWS_PER_LANG, max(LEAST_ROWS, TRAIN_ROWS // max(1, counts.count())))
    w = Window.partitionBy("lang").orderBy("order", "text")
    # the smallest hashes of n rows lie below a share of about most / n of all hashes: rows far above stay out of the
    # window, so a language's task reads a few times its rows however many there are; its first place is always in
    bound = counts.select("lang", F.greatest(F.lit(4 * most) / F.col("n") * 1_000_003, F.col("first") + 1).alias("bound"))
    sample = (rows.join(F.broadcast(bound), "lang").filter(F.col("place") < F.col("bound"))
              .select("lang", training_windows(F.col("text"), F.col("order")).alias("text"), "order")
              .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
              .orderBy("lang", "rank").select("lang", "text").collect())
    if not sample:
        return Network([], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    return train([bytes(r.text) for r in sample], [r.lang for r in sample], seed=seed)


def predict(text: Column, net: Network) -> Column:
    """struct(lang_pred, score) of a text column; whole texts."""
    holder: list[Predictor] = []

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        if not net.langs:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts)})
        if not holder:
            holder.append(Predictor(net))
        lang, score = holder[0].texts(texts.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return run(text)


def accepted(text: Column, net: Network, least: float) -> Column:
    """Whether a text has letters and a language whose score is ``least`` or
    more; a network without languages asks for letters alone."""
    holder: list[Predictor] = []

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        if not net.langs:
            return pd.Series([has_letter(t) for t in texts])
        if not holder:
            holder.append(Predictor(net))
        lang, score = holder[0].texts(texts.tolist())
        return pd.Series([a != UNDETERMINED and b >= least for a, b in zip(lang, score, strict=True)])

    return run(text)


def identify(docs: DataFrame, net: Network | None = None, text_col: str = "text", lang_col: str = "lang",
             id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    net = net or fit(docs, text_col, lang_col, id_col)
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), predict(F.col(f"`{text_col}`"), net).alias("p"))
    return narrow.select("doc_id", (split_of(F.col("doc_id")) == 1).alias("held_out"), "p.lang_pred", "p.score")
