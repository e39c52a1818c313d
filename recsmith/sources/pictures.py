"""Picture files as tables: many pictures in one container, decoded one by one.

A folder of small files costs a request and a task slot each. ``pack`` reads such
a folder once (``binaryFile``: names and bytes) and writes containers: Parquet
files of (pic_id, content), sorted by id, whose row groups are the ranges that
tasks read, and whose statistics let a lookup of some pictures skip the rest.
``decode`` turns the bytes of a row into pixels; a picture that cannot be decoded
is a row like any other, with null pixels and the reason, and costs its task
nothing else.

Formats: portable grey and colour maps (P5, P6) and PNG of 8 bits a channel
without interlacing, which need no library. Others say so in ``error``.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# rows of a container file: bounds a file, and with it a task's row groups
PICTURES_PER_FILE = 50_000
_PNG = b"\x89PNG\r\n\x1a\n"
# fixed values: channels by colour type of a PNG
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
# bounds of a picture's pixels
MOST_PIXELS = 1 << 26


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(pic_id, content) of the files of a folder tree; the id is the name without its ending."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return raw.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("pic_id"), "content")


def pack(pictures: DataFrame, path: str, per_file: int = PICTURES_PER_FILE) -> str:
    """Containers of (pic_id, content) rows; of rows that share an id the one with the smallest bytes stays."""
    one = pictures.filter("pic_id is not null").groupBy("pic_id").agg(F.min("content").alias("content"))
    rows = one.repartitionByRange("pic_id").sortWithinPartitions("pic_id")
    rows.write.option("maxRecordsPerFile", per_file).option("parquet.block.size", 32 << 20).mode("overwrite").parquet(path)
    return path


def scan(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """The pictures of packed containers; with a table of ids, those (null content where there is none)."""
    rows = spark.read.schema("pic_id string, content binary").parquet(path)
    return rows if wanted is None else wanted.select("pic_id").distinct().join(rows, "pic_id", "left")


def _netpbm(data: bytes) -> np.ndarray:
    head = re.match(rb"P([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", data)
    if not head:
        raise ValueError("damaged header")
    width, height, most = (int(head[i]) for i in (2, 3, 4))
    channels = 1 if head[1] == b"5" else 3
    if most != 255:
        raise ValueError(f"{most} levels instead of 255")
    return _pixels(data[head.end():], width, height, channels)


def _pixels(body: bytes, width: int, height: int, channels: int) -> np.ndarray:
    size = width * height * channels
    if not 0 < width * height <= MOST_PIXELS:
        raise ValueError(f"{width} x {height} pixels")
    if len(body) < size:
        raise ValueError(f"{len(body)} of {size} bytes of pixels")
    return np.frombuffer(body[:size], np.uint8).reshape(height, width, channels)


def _png(data: bytes) -> np.ndarray:
    at, body, head = len(_PNG), [], None
    while True:
        if at + 12 > len(data):
            raise ValueError("ends before its last chunk")
        size, kind = struct.unpack(">I4s", data[at:at + 8])
        chunk, crc = data[at + 8:at + 8 + size], data[at + 8 + size:at + 12 + size]
        if len(crc) < 4 or zlib.crc32(kind + chunk) != int.from_bytes(crc, "big"):
            raise ValueError(f"damaged chunk {kind.decode('latin-1')}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or colour not in _CHANNELS:
        raise ValueError(f"depth {depth}, colour type {colour}{', interlaced' if interlaced else ''}")
    channels = _CHANNELS[colour]
    if not 0 < width * height <= MOST_PIXELS:
        raise ValueError(f"{width} x {height} pixels")
    try:
        raw = zlib.decompressobj().decompress(b"".join(body), height * (1 + width * channels))
    except zlib.error as e:
        raise ValueError("damaged pixels") from e
    lines = _pixels(raw, 1 + width * channels, height, 1)[:, :, 0]
    out = np.zeros((height + 1, width * channels), np.int32)
    for y in range(height):                       # each line is stored as its difference from what is known
        kind, line, up = lines[y, 0], lines[y, 1:].astype(np.int32), out[y]
        if kind == 0:
            now = line
        elif kind == 2:
            now = line + up
        elif kind == 1:
            now = line.reshape(width, channels).cumsum(0).ravel()
        elif kind in (3, 4):
            now = np.zeros_like(line)
            for x in range(len(line)):
                left = int(now[x - channels]) if x >= channels else 0
                corner = int(up[x - channels]) if x >= channels else 0
                above = int(up[x])
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    near = left + above - corner
                    guess = min((abs(near - left), 0, left), (abs(near - above), 1, above), (abs(near - corner), 2, corner))[2]
                now[x] = (line[x] + guess) & 255
        else:
            raise ValueError(f"line of kind {kind}")
        out[y + 1] = now & 255
    return out[1:].astype(np.uint8).reshape(height, width, channels)


def pixels(data: bytes | None) -> np.ndarray:
    """(height, width, channels) of a picture's bytes; ValueError says why not."""
    if not data:
        raise ValueError("no bytes")
    if data[:2] in (b"P5", b"P6"):
        return _netpbm(data)
    if data[:8] == _PNG:
        return _png(data)
    raise ValueError("unknown format")


DECODED = "width int, height int, channels int, means array<double>, grid array<float>, error string"


def summary(p: np.ndarray, cells: int) -> tuple[list[float], list[float]]:
    """Mean of each channel, and the mean brightness (0 to 1) of a grid of cells x cells."""
    grey = p.mean(2) / 255
    rows = np.array_split(grey, cells, 0) if p.shape[0] >= cells else [grey[i * p.shape[0] // cells:][:1] for i in range(cells)]
    out = []
    for r in rows:
        cols = np.array_split(r, cells, 1) if p.shape[1] >= cells else [r[:, i * p.shape[1] // cells:][:, :1] for i in range(cells)]
        out += [float(c.mean()) for c in cols]
    return p.mean((0, 1)).tolist(), out


def decode(pictures: DataFrame, cells: int = 8) -> DataFrame:
    """pic_id, width, height, channels, means, grid (brightness of cells x cells
    parts, row by row), error, of every (pic_id, content) row."""
    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column("content").to_pylist():
                try:
                    p = pixels(data)
                    means, grid = summary(p, cells)
                    rows.append((p.shape[1], p.shape[0], p.shape[2], means, grid, None))
                except ValueError as e:
                    rows.append((None, None, None, None, None, str(e)))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float32()), pa.string())
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("pic_id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                                             names=["pic_id", "width", "height", "channels", "means", "grid", "error"])

    return pictures.select("pic_id", "content").mapInArrow(run, f"pic_id string, {DECODED}")
