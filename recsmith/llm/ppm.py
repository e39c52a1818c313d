"""Language-model scoring by prediction by partial matching over bytes.

Every training text adds its bytes, after up to ORDER bytes of context, to a
context trie: counts of (context, next byte) for contexts of 0 to ORDER bytes.
Text starts are filled with byte 0xFE and every text ends with byte 0xFF, which
never occur in UTF-8. A symbol is coded in the longest known context that has
seen it; each context above escapes with the probability d / (n + d) (d
distinct symbols, n occurrences: method C), and symbols that a longer context
has seen are excluded from the counts of the shorter ones. Below order 0 all
256 byte values are equally likely, without those excluded. The model is
pretrained: counts come from the training texts and stay fixed while a text is
scored.

The trie is counted by Spark: tasks count the longest contexts of their texts by
sorting codes, the counts are added by code, and shorter contexts are sums of
longer ones. The counts cover all training texts and stay in Spark, uncut. The
MAX_NODES most frequent (context, symbol) pairs of the longest contexts go to
the workers with their probabilities, as a cache; the distinct other codes of
each text are joined with the counts of every order, which give their exact
probabilities. The size of the cache does not change a score.

The base score uses counts of all words of the training texts. The HEAD_WORDS
most frequent ones go to the workers; every other word of a text is looked up by
a join on its 64-bit hash.

Defined results: null text is empty (one token, the end); repeated rows and null
ids are scored row by row; without training texts all words are unknown and all
bytes equally likely; a document id that is null counts as the empty string for
the split; texts of any length are scored whole; scores are sums, so there are
no ties to break; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recsmith.llm.common import materialize

ORDER = 4
MAX_NODES = 1 << 20
HEAD_WORDS = 1 << 20
START, END = 0xFE, 0xFF
WORD, NODE = 0, 1
_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))      # A-Z to a-z


def split_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 10; remainder 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def codes(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) codes of all bytes and ends, ``order`` context bytes
    above the symbol's; and where each text's codes begin."""
    pad = bytes([START]) * order
    flat = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts) or pad, np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    cut = np.concatenate([[0], np.cumsum(size)])
    n = len(flat) - order
    code = np.zeros(max(0, n), _U)
    for j in range(order + 1):
        code <<= _U(8)
        code |= flat[j:n + j]
    # places whose symbol is another text's filling are left out
    keep = np.ones(len(code), bool)
    for j in range(order):
        at = cut[1:-1] + order * np.arange(len(texts) - 1) + j
        keep[at] = False
    return code[keep], cut


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and their counts."""
    s = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.append(first, len(s)))


def hash_words(words: list[bytes]) -> np.ndarray:
    flat = np.empty(len(words), object)
    flat[:] = words
    return pd.util.hash_array(flat, categorize=False) if words else np.zeros(0, _U)


def gather(texts: DataFrame, order: int = ORDER, hold: int = 1 << 21) -> DataFrame:
    """kind, code, n: partial counts of words (and the end, code 0) and of the
    longest contexts; a task holds about ``hold`` codes before it counts them."""
    def run(batches):
        kept = {WORD: [], NODE: []}
        waiting = 0

        def out():
            for kind, parts in kept.items():
                if parts:
                    all_codes = np.concatenate([c for c, _ in parts])
                    all_n = np.concatenate([n for _, n in parts])
                    at = np.argsort(all_codes, kind="stable")
                    c, n = all_codes[at], all_n[at]
                    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                    n = np.add.reduceat(n, first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(first), kind, np.int32)), pa.array(c[first].view(np.int64)), pa.array(n)],
                        names=["kind", "code", "n"])
                    parts.clear()

        for batch in batches:
            texts = [folded(t) for t in batch.column("text").to_pylist()]
            k = 0
            while k < len(texts):                # groups of about 4 MB, one long text may be more
                group, size = [], 0
                while k < len(texts) and size < 1 << 22:
                    group.append(texts[k])
                    size += len(texts[k])
                    k += 1
                words = [w for t in group for w in t.split()]
                ends = (np.zeros(1, _U), np.array([len(group)], np.int64))
                for kind, pair in ((WORD, counted(hash_words(words))), (WORD, ends), (NODE, counted(codes(group, order)[0]))):
                    kept[kind].append(pair)
                    waiting += len(pair[0])
                if waiting > hold:
                    yield from out()
                    waiting = 0
        yield from out()

    return texts.mapInArrow(run, "kind int, code bigint, n bigint")


class Cache:
    """Open addressing table: longest code -> log10 probability."""

    def __init__(self, code: np.ndarray, logp: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(2, 2.5 * len(code))))))
        self.shift = _U(64 - bits)
        self.key = np.full(1 << bits, ~_U(0))
        self.val = np.zeros(1 << bits, np.float32)
        slot, left = (code * _MIX >> self.shift).astype(np.int64), np.arange(len(code))
        while len(left):
            free = self.key[slot[left]] == ~_U(0)
            taken, first = np.unique(slot[left[free]], return_index=True)
            placed = left[free][first]
            self.key[taken], self.val[taken] = code[placed], logp[placed]
            done = np.zeros(len(code), bool)
            done[placed] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & (len(self.key) - 1)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes' values, 0 if missing; and where codes are missing."""
        out = np.empty(len(code), np.float64)
        slot = (code * _MIX >> self.shift).astype(np.int64)
        key = self.key[slot]
        hit = key == code
        out[:] = self.val[slot]
        look = np.flatnonzero(~hit & (key != ~_U(0)))
        miss = [np.flatnonzero(key == ~_U(0))]
        at = slot[look]
        while len(look):
            at = (at + 1) & (len(self.key) - 1)
            key = self.key[at]
            found = key == code[look]
            out[look[found]] = self.val[at[found]]
            empty = key == ~_U(0)
            miss.append(look[empty])
            go = ~found & ~empty
            look, at = look[go], at[go]
        rest = np.sort(np.concatenate(miss))
        out[rest] = 0
        return out, rest


class Model:
    """Scores texts in memory with counts of each order: {order: (codes, counts)}."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.order = order
        self.codes, self.counts, self.ctx = {}, {}, {}
        for o in range(order, -1, -1):
            c, n = tables.get(o, (np.zeros(0, _U), np.zeros(0, np.int64)))
            at = np.argsort(c)
            self.codes[o], self.counts[o] = c[at], n[at].astype(np.float64)
        for o in range(order, -1, -1):
            ctx = self.codes[o] >> _U(8)
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
            total = np.add.reduceat(self.counts[o], first) if len(first) else np.zeros(0)
            distinct = np.diff(np.append(first, len(ctx))).astype(np.float64)
            # what the symbols seen here hold in the context one byte shorter
            below, seen = np.zeros(len(first)), np.zeros(len(first))
            if o and len(first):
                found, at = self._find(o - 1, self.codes[o] & self._mask(o - 1))
                share = np.where(found, self.counts[o - 1][at], 0.0)
                below, seen = np.add.reduceat(share, first), np.add.reduceat(found.astype(float), first)
            self.ctx[o] = (ctx[first] if len(first) else ctx, total, distinct, below, seen)
        self._table()

    @staticmethod
    def _mask(order: int) -> np.uint64:
        return _U((1 << 8 * (order + 1)) - 1)

    def _find(self, o: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.codes[o]
        if not len(own):
            return np.zeros(len(code), bool), np.zeros(len(code), np.int64)
        at = np.minimum(np.searchsorted(own, code), len(own) - 1)
        return own[at] == code, at

    def _table(self) -> None:
        """The pairs that the longest contexts have seen."""
        code, n = self.codes[self.order], self.counts[self.order]
        ctx, total, distinct, _, _ = self.ctx[self.order]
        at = np.searchsorted(ctx, code >> _U(8))
        self.cache = Cache(code, np.log10(n / (total[at] + distinct[at])) if len(code) else np.zeros(0))

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each (context, symbol) code."""
        out, rest = self.cache.find(code)
        if len(rest):
            distinct, back = np.unique(code[rest], return_inverse=True)
            out[rest] = self._escaped(distinct)[back]
        return out

    def _escaped(self, code: np.ndarray) -> np.ndarray:
        """The same by the full chain of contexts."""
        logp, open_ = np.zeros(len(code)), np.ones(len(code), bool)
        off_n, off_d = np.zeros(len(code)), np.zeros(len(code))     # excluded counts and symbols
        for o in range(self.order, -1, -1):
            mine = code & self._mask(o)
            ctx, total, distinct, below, seen = self.ctx[o]
            if not len(ctx):
                off_n[:], off_d[:] = 0, 0
                continue
            at = np.minimum(np.searchsorted(ctx, mine >> _U(8)), len(ctx) - 1)
            known = ctx[at] == mine >> _U(8)
            n, d = np.maximum(total[at] - off_n, 0), np.maximum(distinct[at] - off_d, 0)
            found, i = self._find(o, mine)
            room = n + d
            with np.errstate(divide="ignore", invalid="ignore"):
                take = open_ & known & found & (room > 0)
                logp[take] += np.log10(self.counts[o][i[take]] / room[take])
                open_ &= ~take
                esc = open_ & known & (d > 0)
                logp[esc] += np.log10(d[esc] / room[esc])
            off_n = np.where(known, below[at], 0)
            off_d = np.where(known, seen[at] if o else distinct[at], 0)
        left = np.maximum(1, 256 - off_d[open_])
        logp[open_] -= np.log10(left)
        return logp

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        if not texts:
            return np.zeros(0)
        code, cut = codes(texts, self.order)
        return np.add.reduceat(self.log10(code), cut[:-1])


def count(texts: DataFrame, order: int = ORDER) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The counts (code, n) of words, and of the nodes of each order, of (text) rows."""
    counts = materialize(gather(texts, order).groupBy("kind", "code").agg(F.sum("n").alias("n")), "ppm-counts")
    tables = {order: counts.filter(F.col("kind") == NODE).select("code", "n")}
    for o in range(order - 1, -1, -1):       # a shorter context: the longer codes without their first byte
        tables[o] = materialize(tables[o + 1].select(_tail(F.col("code"), o).alias("code"), "n")
                                .groupBy("code").agg(F.sum("n").alias("n")), "ppm-nodes")
    return counts.filter(F.col("kind") == WORD).select("code", "n"), tables


def train(texts: DataFrame, order: int = ORDER, max_nodes: int = MAX_NODES) -> tuple[DataFrame, Model]:
    """The words' counts (code, n) and the model in memory, of ``max_nodes``
    nodes of each order at most, of (text) rows."""
    words, tables = count(texts, order)
    return words, Model({o: _bounded(t, max_nodes) for o, t in tables.items()}, order)


def _tail(code: Column, order: int) -> Column:
    """The part of a longer code that a context of ``order`` bytes and the symbol have."""
    return code.bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def _sized(table: DataFrame, length: int) -> DataFrame:
    """For a join by codes of ``length`` bytes: up to 2 bytes there are 65,536
    rows at most; others grow and are never broadcast."""
    return F.broadcast(table) if length <= 2 else table.hint("merge")


def contexts(tables: dict[int, DataFrame]) -> dict[int, DataFrame]:
    """ctx, total, distinct, below of each order: occurrences and distinct
    symbols of a context, and what these symbols hold in the context one byte shorter."""
    out = {}
    for o, nodes in tables.items():
        each = nodes.select("code", "n", F.lit(0).cast("long").alias("below"))
        if o:
            shorter = tables[o - 1].select(F.col("code").alias("short"), F.col("n").alias("below"))
            each = nodes.withColumn("short", _tail(F.col("code"), o - 1)).join(_sized(shorter, o), "short")
        out[o] = materialize(each.groupBy(F.shiftright("code", 8).alias("ctx")).agg(
            F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("below").alias("below")), "ppm-contexts")
    return out


def probabilities(wanted: DataFrame, tables: dict[int, DataFrame], ctx: dict[int, DataFrame]) -> DataFrame:
    """code, logp of distinct codes, by the full chain of contexts (as in ``Model._escaped``)."""
    at = wanted.select("code", F.lit(0.0).alias("logp"), F.lit(True).alias("open"),
                       F.lit(0).cast("long").alias("off_n"), F.lit(0).cast("long").alias("off_d"))
    for o in range(max(tables), -1, -1):
        at = at.withColumn("mine", _tail(F.col("code"), o)).withColumn("ctx", F.shiftright("mine", 8))
        at = at.join(_sized(tables[o].withColumnRenamed("code", "mine"), o + 1), "mine", "left")
        at = at.join(_sized(ctx[o], o), "ctx", "left")
        at = at.select("code", "logp", "open", "n", "distinct", "below", "off_n", "off_d",
                       F.greatest(F.col("distinct") - F.col("off_d"), F.lit(0)).alias("d"),
                       F.greatest(F.col("total") - F.col("off_n"), F.lit(0)).alias("left"))
        room = F.col("d") + F.col("left")
        take = F.col("open") & F.col("n").isNotNull() & F.coalesce(room > 0, F.lit(False))
        escape = F.col("open") & F.coalesce(F.col("d") > 0, F.lit(False))
        at = at.select("code", (F.col("logp") + F.when(take, F.log10(F.col("n") / room)).when(escape, F.log10(F.col("d") / room))
                                .otherwise(0.0)).alias("logp"), (F.col("open") & ~take).alias("open"),
                       F.coalesce("below", F.lit(0)).alias("off_n"), F.coalesce("distinct", F.lit(0)).alias("off_d"))
    return at.select("code", (F.col("logp") - F.when(F.col("open"), F.log10(F.greatest(F.lit(1), 256 - F.col("off_d"))))
                              .otherwise(0.0)).alias("logp"))


def _frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows whose count reaches a power of two, the least such that ``most`` rows or fewer do."""
    least = 1
    if table.count() > most:
        sizes = table.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
        kept, least = 0, 2 << sizes[0].power
        for r in sizes:
            kept += r["count"]
            if kept > most:
                break
            least = 1 << r.power
    return table.filter(F.col("n") >= least)


def _bounded(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    got = _frequent(table, most).toArrow()
    return got.column("code").to_numpy().astype(np.int64).view(_U), got.column("n").to_numpy()


def score(docs: DataFrame, order: int = ORDER, max_nodes: int = MAX_NODES, head_words: int = HEAD_WORDS,
          text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every row. ``max_nodes`` and ``head_words`` bound the workers' caches."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    words, tables = count(rows.filter(split_of(F.col("doc_id")) != 0).select("text"), order)
    words, ctx = materialize(words, "ppm-words"), contexts(tables)
    frequent = (_frequent(tables[order], max_nodes).withColumn("ctx", F.shiftright("code", 8)).join(_sized(ctx[order], order), "ctx")
                .select("code", F.log10(F.col("n") / (F.col("total") + F.col("distinct"))).alias("logp")).toArrow())
    cache = Cache(frequent.column("code").to_numpy().astype(np.int64).view(_U), frequent.column("logp").to_numpy())
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, room = int(total.n), total.n + 0.1 * (total.v + 1)
    head_codes, head_n = _bounded(words, head_words)
    at = np.argsort(head_codes)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((cache, head_codes[at], np.log10(head_n[at] + 0.1)))
    unknown = float(np.log10(0.1))

    def run(batches):
        m, codes_, logs = shared.value
        serial = 0
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [folded(t) for t in batch.column("text").to_pylist()]
            k, n_tokens, n_head, head, ppm, tail, rare, times = 0, [], [], [], [], [], [], []
            while k < len(texts):
                group, size = [], 0
                while k < len(texts) and size < 1 << 21:
                    group.append(texts[k])
                    size += len(texts[k])
                    k += 1
                parts = [t.split() for t in group]
                cut = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
                h = np.zeros(cut[-1], _U)
                inner = np.ones(cut[-1], bool)
                inner[cut[1:] - 1] = False           # the end's code is 0
                h[inner] = hash_words([w for p in parts for w in p])
                if len(codes_):
                    i = np.minimum(np.searchsorted(codes_, h), len(codes_) - 1)
                    known = codes_[i] == h
                    value = np.where(known, logs[i], 0)
                else:
                    known, value = np.zeros(len(h), bool), np.zeros(len(h))
                n_tokens += np.diff(cut).tolist()
                n_head += np.add.reduceat(known.astype(np.int64), cut[:-1]).tolist()
                head += np.add.reduceat(value, cut[:-1]).tolist()
                code, start = codes(group, order)
                logp, rest = m.find(code)
                ppm += np.add.reduceat(logp, start[:-1]).tolist()
                part = np.searchsorted(rest, start)
                for a, b in zip(part, part[1:], strict=False):
                    c, n = counted(code[rest[a:b]])
                    rare.append(c.view(np.int64))
                    times.append(n)
                tail += [h[a:b][~known[a:b]].view(np.int64) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.arange(serial, serial + len(texts)) + base, pa.int64()),
                 pa.array(n_tokens, pa.int64()), pa.array(n_head, pa.int64()), pa.array(head, pa.float64()),
                 pa.array(ppm, pa.float64()), pa.array(tail, pa.list_(pa.int64())),
                 pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                names=["doc_id", "row", "n_tokens", "n_head", "head", "score", "tail", "rare", "times"])
            serial += len(texts)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = materialize(rows.mapInArrow(run, f"doc_id {id_type}, row bigint, n_tokens bigint, n_head bigint, "
                                              "head double, score double, tail array<bigint>, rare array<bigint>, times array<bigint>"), "ppm-scored")
    # the rare words of each text, by join
    tails = scored.select("row", F.explode("tail").alias("code")).groupBy("row", "code").agg(F.count("*").alias("tf"))
    tails = (tails.join(words, "code", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("n_tail"),
        F.sum(F.col("tf") * F.coalesce(F.log10(F.col("n") + 0.1), F.lit(unknown))).alias("tail_score")))
    # the codes that the cache lacks, by joins with the counts of every order
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("code"), F.col("x.times").alias("tf"))
    exact = probabilities(materialize(rare.select("code").distinct(), "ppm-rare"), tables, ctx)
    rare = (rare.join(materialize(exact, "ppm-exact").hint("merge"), "code").groupBy("row")
            .agg(F.sum(F.col("tf") * F.col("logp")).alias("rare_score")))
    out = scored.drop("tail", "rare", "times").join(tails, "row", "left").join(rare, "row", "left")
    return out.select(
        "doc_id", (split_of(F.col("doc_id")) == 0).alias("held_out"), "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("head") + F.coalesce("tail_score", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(room)) if room > 0 else 0.0)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))
