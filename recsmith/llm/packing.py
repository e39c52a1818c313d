"""Packing by vector bin packing.

A document becomes token ids plus a closing id. Pieces of documents are placed
into sequences under three limits at once: tokens, segments and loss-bearing
tokens. The open sequence takes, of the pieces that fit, the one whose demand
vector has the largest dot product with the sequence's remaining room (both in
shares of the limits). When no piece fits whole, the best one is cut to fill
the room; what is left of it stays in the pool.

Every scan partition packs its own rows as a stream: no shuffle, and no more
than ``pool`` waiting pieces in memory. Long documents fill whole sequences
first; only their remainders wait. The last rows of a partition, less than one
sequence, are laid out as sequences whose lengths are powers of two, which
need no padding.

Defined results: null text counts as empty and gives the closing id alone; a
null doc_id is kept as null; repeated rows are packed each on their own; an
empty table gives an empty table; ties of the heuristic go to the piece that
came first; texts of any length are packed whole; other input columns are
ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, loss_tokens bigint")


#: Characters of the texts whose distinct chunks are looked up together.
GROUP_CHARS = 4_000_000


@dataclass(frozen=True)
class Limits:
    """Limits of one sequence."""
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


def byte_level() -> dict[int, str]:
    """Characters by which a byte-level vocabulary writes the bytes of a text:
    printable ones of Latin-1 stand for themselves, the others for 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts with a word-level BPE file of `tokenizers`.

    The tokenizer lower-cases, splits at white space and between letter runs,
    digits and other runs, and encodes every run on its own, so the ids of a
    white-space delimited chunk do not depend on its neighbours. A batch of
    texts is split into chunks by Arrow, its distinct chunks are looked up or
    learnt once, and the ids of all places are gathered from one array. What is
    remembered (chunks, runs and ids) stays within ``keep`` bytes. Texts with
    characters outside the plain ranges below go through the tokenizer whole.
    """

    # printable ASCII, tab and line ends, Latin letters without special case rules
    _ODD = re.compile("[^\t\n\r\x20-\x7eÀ-įı-ž]")
    _PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ž]+|[0-9]|[^\\sa-z0-9À-ÖØ-öø-ž]+")

    def __init__(self, path: str, keep: int = 192 << 20):
        from tokenizers import Tokenizer
        self.tk = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u4" if self.tk.get_vocab_size() > 65_536 else "<u2")
        self.keep, table = keep, byte_level()
        # the characters of the plain ranges beyond ASCII, as the vocabulary writes their bytes
        self.spelled = {c: "".join(table[b] for b in chr(c).encode()) for c in range(0x80, 0x180)}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}           # chunk or run: its place in start and length
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids, self.used = np.zeros(1 << 18, self.dtype), 0

    def _size(self) -> int:
        """Bytes remembered: about 160 for a chunk besides its ids."""
        return 160 * len(self.known) + self.ids.nbytes + self.start.nbytes + self.length.nbytes

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tk.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at many places one after the other, and where each ends."""
        start, ends = self.start[place], np.cumsum(self.length[place], dtype=np.int64)
        first = start - ends + self.length[place]
        return self.ids[np.repeat(first, self.length[place]) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _keep(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Remembers the ids of names, one after the other."""
        n = len(self.known)
        while n + len(names) > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used:self.used + len(ids)] = ids
        self.start[n:n + len(names)] = self.used + np.cumsum(size) - size
        self.length[n:n + len(names)] = size
        self.used += len(ids)
        self.known.update(zip(names, range(n, n + len(names)), strict=True))

    def _learn(self, new: list[str]) -> None:
        """Runs are encoded, chunks of several runs put together from them."""
        pieces, tokenize, spelled = self._PIECE.findall, self.tk.model.tokenize, self.spelled
        mixed = [c for c in new if not c.isalpha()]
        parts = [pieces(c) for c in mixed]
        runs = {c for c in new if c.isalpha()}
        runs.update(p for ps in parts for p in ps if p not in self.known)
        names = list(runs)
        found = [[t.id for t in tokenize(r if r.isascii() else r.translate(spelled))] for r in names]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self._keep(names, np.fromiter(itertools.chain.from_iterable(found), self.dtype, int(size.sum())), size)
        several = [(c, ps) for c, ps in zip(mixed, parts, strict=True) if c not in self.known]
        if several:
            known, count = self.known.__getitem__, [len(ps) for _, ps in several]
            ids, ends = self._gather(np.fromiter((known(p) for _, ps in several for p in ps), np.int64, sum(count)))
            cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
            self._keep([c for c, _ in several], ids, np.diff(cut))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self._size() > self.keep:
            self._forget()
        odd = [bool(self._ODD.search(t)) for t in texts]
        split = pc.ascii_split_whitespace(pa.array([t.lower() for t, o in zip(texts, odd, strict=True) if not o], pa.large_string()))
        chunks = split.flatten().dictionary_encode()
        names = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.known.get, names, itertools.repeat(-1)), np.int64, len(names))
        if len(new := np.flatnonzero(place < 0)):
            fresh = [names[i] for i in new.tolist()]
            self._learn(fresh)
            place[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        ids, ends = self._gather(place[chunks.indices.to_numpy()])
        cut = np.concatenate([[0], ends])[split.offsets.to_numpy()] * self.dtype.itemsize
        raw, spans = ids.tobytes(), zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)
        return [self._whole(t) if o else raw[slice(*next(spans))] for t, o in zip(texts, odd, strict=True)]


class Packer:
    """Pieces in, placements out. A piece is [document, start, end): a document
    is (doc_id, ids, n ids, first loss-bearing position); one that comes out has
    the place of the first of its ids added. A piece that waits keeps its own ids
    and not those before it."""

    def __init__(self, limits: Limits, pool: int = 512):
        self.lim, self.pool = limits, pool
        self.docs: list[tuple] = []
        self.start = np.zeros(2 * pool, np.int64)
        self.end = np.zeros(2 * pool, np.int64)
        self.first_loss = np.zeros(2 * pool, np.int64)
        self.n = 0
        self.sequences = 0

    def _loss(self, start, end, first):
        return np.maximum(0, end - np.maximum(start, first))

    def _room(self, start: int, end: int, first: int, tokens: int, loss: int) -> int:
        """The longest prefix of a piece within the given room."""
        return max(0, min(end - start, tokens, max(0, first - start) + loss))

    def add(self, doc: tuple) -> Iterator[list[tuple]]:
        key, ids, n, first = doc
        width, start, doc = len(ids) // n, 0, (key, ids, n, first, 0)
        while True:                      # whole sequences of one long document
            take = self._room(start, n, first, self.lim.tokens, self.lim.loss)
            if take >= n - start and take < self.lim.tokens:
                break
            yield self._close([(doc, start, start + take)])
            start += take
            if start == n:
                return
        k = self.n
        self.docs.append((key, ids[start * width:], n, first, start) if start else doc)
        self.start[k], self.end[k], self.first_loss[k] = start, n, first
        self.n += 1
        if self.n == len(self.start):
            yield from self.drain(self.pool)

    def _close(self, placed: list[tuple]) -> list[tuple]:
        rows, at = [], 0
        for doc, s, e in placed:
            rows.append((doc, s, e, self.sequences, at))
            at += e - s
        self.sequences += 1
        return rows

    def _one(self) -> list[tuple]:
        lim, k = self.lim, self.n
        start, end, first = self.start[:k], self.end[:k], self.first_loss[:k]
        alive = np.ones(k, bool)
        size = end - start
        loss = self._loss(start, end, first)
        room_t, room_s, room_l = lim.tokens, lim.segments, lim.loss
        placed = []
        while room_t and room_s and alive.any():
            score = ((room_t / lim.tokens) * (size / lim.tokens) + (room_s / lim.segments) / lim.segments
                     + (room_l / lim.loss) * (loss / lim.loss))
            fits = alive & (size <= room_t) & (loss <= room_l)
            if fits.any():
                i = int(np.argmax(np.where(fits, score, -1.0)))
                placed.append((self.docs[i], int(start[i]), int(end[i])))
                room_t, room_l, room_s = room_t - int(size[i]), room_l - int(loss[i]), room_s - 1
                alive[i] = False
                continue
            take = np.maximum(0, np.minimum(np.minimum(size, room_t), np.maximum(0, first - start) + room_l))
            i = int(np.argmax(np.where(alive, take, -1)))
            t = int(take[i])
            if t <= 0:
                break
            placed.append((self.docs[i], int(start[i]), int(start[i]) + t))
            start[i] += t
            size[i] -= t
            loss[i] = self._loss(start[i], end[i], first[i])
            room_t, room_s = room_t - t, room_s - 1
            room_l -= int(self._loss(placed[-1][1], placed[-1][2], first[i]))
        keep = np.flatnonzero(alive)
        self.docs = [self.docs[i] for i in keep]
        for a in (self.start, self.end, self.first_loss):
            a[:len(keep)] = a[keep]
        self.n = len(keep)
        return self._close(placed)

    def drain(self, down_to: int) -> Iterator[list[tuple]]:
        """Sequences until at most ``down_to`` pieces, or with 0 less than a
        sequence, wait."""
        while self.n > down_to and (down_to or int((self.end[:self.n] - self.start[:self.n]).sum()) >= self.lim.tokens):
            yield self._one()

    def finish(self) -> Iterator[list[tuple]]:
        """Everything that waits; the last part in lengths that are powers of two."""
        yield from self.drain(0)
        full = self.lim
        while self.n:
            left = int((self.end[:self.n] - self.start[:self.n]).sum())
            self.lim = Limits(min(full.tokens, 1 << (left.bit_length() - 1)), full.segments, full.loss)
            yield self._one()
        self.lim = full


_TOKENIZERS: dict[str, WordTokenizer] = {}       # one for each worker process and file


def pack(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), close_id: int = 1, pool: int = 512,
         text_col: str = "text", id_col: str = "doc_id", loss_from: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, loss_tokens. ``loss_from`` names a column with the
    first loss-bearing token position of a document (null or unset: 0)."""
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("limits are 1 at least")
    first = F.col(f"`{loss_from}`").cast("long") if loss_from else F.lit(0).cast("long")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                         F.greatest(F.lit(0), F.coalesce(first, F.lit(0))).cast("long").alias("first"))

    def run(batches):
        from pyspark import TaskContext
        tk = _TOKENIZERS.get(tokenizer_path) or _TOKENIZERS.setdefault(tokenizer_path, WordTokenizer(tokenizer_path))
        closing = np.asarray([close_id], dtype=tk.dtype).tobytes()
        width = tk.dtype.itemsize
        base = TaskContext.get().partitionId() << 40
        packer = Packer(limits, pool)

        def rows(sequences):
            cols = [[] for _ in range(8)]
            for seq in sequences:
                for (doc, ids, n, lf, base_id), s, e, q, at in seq:
                    part = ids[(s - base_id) * width:(e - base_id) * width]
                    crc = zlib.crc32(np.frombuffer(part, dtype=tk.dtype).astype("<u4").tobytes())
                    for c, v in zip(cols, (doc, s, e - s, crc, n, base + q, at, max(0, e - max(s, lf))), strict=True):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                              names=[x.split()[0] for x in SCHEMA.split(", ")])

        def of(batch):
            ids, firsts = batch.column("doc_id").to_pylist(), batch.column("first").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            k = 0
            while k < len(texts):            # groups of a bounded number of characters; one long text may be more
                size, end = 0, k
                while end < len(texts) and size < GROUP_CHARS:
                    size, end = size + len(texts[end]), end + 1
                for i, b in enumerate(tk.encode(texts[k:end]), k):
                    b += closing
                    yield from packer.add((ids[i], b, len(b) // width, firsts[i]))
                k = end

        for batch in batches:
            yield rows(of(batch))
        yield rows(packer.finish())

    return narrow.mapInArrow(run, SCHEMA)
