"""WARC archives: writing, and reading by boundary-chain verification.

Writing. Every row becomes a record: ``WARC/1.1``, header lines, an empty line,
an HTTP header block and the payload. Of the records with equal payloads (of
``least_bytes`` at least) the one with the smallest id is a ``response``, the
others are ``revisit`` records without payload that refer to it. The files are
written by Spark, a stream of records per task, compressed as one gzip stream,
so that a file is read by one task; ``rows_per_file`` bounds them.

Reading. Records are not found by their magic alone, which may stand inside a
payload: tasks take every ``WARC/1.`` at a line start as a candidate, read the
length in its header and emit (file, offset, successor offset). Starting from
offset 0 of each file, pointer jumping doubles the known chain: every round
marks the successors of the marked candidates and squares the successor map, so
a file of n records takes log2(n) rounds of joins on (file, offset). Only marked
candidates are records. Payload lengths and digests are computed from the bytes
that were read; a revisit takes them from the record that it refers to.

Defined results: a null payload is empty; null ids and repeated rows are kept,
row by row (rows that share an id and a payload are all responses, or all
revisits); a null url has no target line; line ends in a url are written as
%0D and %0A; a file that ends inside a record, or whose chain meets bytes that
are no record, raises an error; ids are integers; payloads of any length are kept
whole; of equal payloads the smallest id is the response; an empty table gives
an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recsmith.llm.common import materialize
from recsmith.session import checkpoint_dir

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"(?m)^([A-Za-z-]+):[ \t]*([^\r\n]*)\r?$")


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, 32 characters: eight for every five bytes."""
    digest = F.sha1(data)
    out = []
    for k in range(4):
        value = F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(BASE32), (F.shiftright(value, 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*out)


def _record(kind: str) -> Column:
    """A record as text; the writer adds the two line ends that close it."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
    payload = F.col("payload") if kind == "response" else F.lit("")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    refers = line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">")))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        F.lit(f"WARC-Date: 2024-01-01T00:00:00Z{CRLF}"), F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(refers, F.lit("")) if kind == "revisit" else F.lit(""),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", (F.octet_length(payload) + len(http)).cast("string")), F.lit(CRLF + http), payload)


def write(pages: DataFrame, path: str, least_bytes: int = 0, rows_per_file: int = 100_000,
          id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes the archive files under ``path``. Which rows are revisits is found
    on (id, digest) rows alone. What joins the payloads is one row per revisit,
    by id and digest: it is broadcast if it is small, and else the payloads move
    once, evenly by their ids, however many of them are equal."""
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    rows = rows.select("*", sha1_base32(F.col("payload").cast("binary")).alias("digest"))
    first = (rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    narrow = rows.filter(F.octet_length("payload") >= least_bytes).select("page_id", "digest")
    revisits = (narrow.join(first, "digest").filter(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
                .select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first_id").distinct())
    revisits = materialize(revisits, "warc-revisits")
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    (rows.select(F.when(F.col("first_id").isNotNull(), _record("revisit")).otherwise(_record("response")).alias("value"))
     .write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", rows_per_file).text(path))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place that looks like a record: file, at, next, whether all its
    bytes were there, its fields, and the length and digest of its payload; and
    a row without ``next`` at each file's end.

    The files are read in pieces between empty lines. A candidate's header ends
    with its piece; its block is summed up while later pieces go by, so a task
    holds running digests, not payloads. A piece that an empty line closes never
    ends in a line end, as the empty line would start there: one that does is
    the rest of a file whose last payload ends in an odd number of line ends."""
    sep = CRLF + CRLF
    pieces = (spark.read.option("lineSep", sep).text(path)
              .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.col("value").cast("binary").alias("value")))
    fields = ["WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Payload-Digest"]
    names = ["file", "at", "next", "whole", "kind", "id", "refers", "said", "payload_bytes", "digest"]

    def run(batches):
        done: list[tuple] = []
        open_: list[dict] = []
        here, at = None, 0

        def close(c: dict, whole: bool) -> None:
            # the payload follows the empty line that ends the HTTP header
            size = c["payload"] if whole else None
            digest = base64.b32encode(c["sha"].digest()).decode() if whole else None
            done.append((c["file"], c["at"], c["next"], whole, *c["fields"], size, digest))

        def end_file() -> None:
            for c in open_:
                close(c, False)
            open_.clear()
            if here is not None:
                done.append((here, at, None, True, None, None, None, None, None, None))

        def feed(data: bytes, start: int) -> None:
            """Bytes from file offset ``start`` on go to the candidates that own them."""
            for c in list(open_):
                lo, hi = max(start, c["body"]), min(start + len(data), c["end"])
                if hi > lo:
                    part = data[lo - start:hi - start]
                    if c["http"] is not None:
                        c["http"] += part
                        cut = c["http"].find(b"\r\n\r\n")
                        if cut < 0:
                            part = b""
                        else:
                            part, c["http"] = bytes(c["http"][cut + 4:]), None
                    if part:
                        c["sha"].update(part)
                        c["payload"] += len(part)
                if start + len(data) >= c["end"]:
                    open_.remove(c)
                    close(c, True)

        for batch in batches:
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            for f, b, value in zip(files, blocks, batch.column("value").to_pylist(), strict=True):
                if b:
                    raise ValueError(f"{f} was split between tasks; archives are read whole, write them compressed")
                if f != here:
                    end_file()
                    here, at = f, 0
                data = value if value.endswith(b"\r\n") else value + b"\r\n\r\n"
                end = at + len(data)
                feed(data, at)
                for m in _MAGIC.finditer(value):
                    head = dict(_FIELD.findall(value[m.end():]))
                    length = head.get(b"Content-Length", b"")
                    if length.isdigit() and len(length) < 16:
                        last = end + int(length)
                        c = {"file": f, "at": at + m.start(), "next": last + 4, "body": end, "end": last, "http": bytearray(),
                             "sha": hashlib.sha1(), "payload": 0,
                             "fields": [head[k.encode()].decode("utf-8", "replace") if k.encode() in head else None for k in fields]}
                        if last == end:
                            close(c, True)
                        else:
                            open_.append(c)
                at = end
            if len(done) > 20_000:
                yield table(done)
        end_file()
        yield table(done)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def table(done: list[tuple]):
        cols = list(zip(*done, strict=True)) if done else [[] for _ in names]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        done.clear()
        return out

    return pieces.mapInArrow(run, "file string, at bigint, next bigint, whole boolean, kind string, id string, refers string, "
                                  "said string, payload_bytes bigint, digest string")


def chain(found: DataFrame) -> DataFrame:
    """(file, at) of the candidates that a file's chain of records reaches, by
    pointer jumping from offset 0.

    The tables have a row per candidate and compress to a few bytes a row, so
    their file size says little about their size in memory: the joins are merge
    joins by hint, never broadcasts."""
    jump = materialize(found.filter("next is not null").select(F.xxhash64("file").alias("f"), "file", "at", "next"), "warc-jump")
    marked = materialize(jump.filter("at = 0").select("f", "file", "at"), "warc-marked")
    key, n = ["f", "file", "at"], marked.count()
    while True:
        ahead = marked.join(jump.hint("merge"), key).select("f", "file", F.col("next").alias("at"))
        # successors that are candidates themselves; others are the file's end
        ahead = ahead.join(jump.select(*key).hint("merge"), key, "left_semi")
        marked = materialize(marked.unionByName(ahead).distinct(), "warc-marked")
        more = marked.count()
        if more == n:
            return marked.drop("f")
        n = more
        # a pointer that leaves the candidates stays where it is
        far = jump.select("f", "file", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = materialize(jump.join(far.hint("merge"), ["f", "file", "next"], "left")
                           .select(*key, F.coalesce("far", "next").alias("next")), "warc-jump")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    found = materialize(candidates(spark, path), "warc-candidates")
    real = materialize(found.filter("next is not null").join(chain(found), ["file", "at"]), "warc-records")
    # the last record of a file's chain ends where the file does
    ends = found.filter("next is null").select("file", F.col("at").alias("next"))
    odd = (real.filter(~F.col("whole")).select("file").limit(1).collect()
           or ends.join(real.select("file", "next"), ["file", "next"], "left_anti").limit(1).collect())
    if odd:
        raise ValueError(f"broken archive: {odd[0].file}")
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    rows = real.select(number(F.col("id")).alias("page_id"), F.col("kind").alias("record_type"), number(F.col("refers")).alias("refers_to"),
                       F.regexp_replace("said", "^sha1:", "").alias("said"), "payload_bytes", "digest")
    full = (rows.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("digest").alias("said"),
                                                           F.col("payload_bytes").alias("full_bytes")).distinct())
    again = rows.filter("record_type = 'revisit'").join(full, ["refers_to", "said"], "left")
    if not again.filter("full_bytes is null").isEmpty():
        raise ValueError("a revisit refers to no record with its payload")
    return rows.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    ).unionByName(again.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("said").alias("payload_digest"),
                               "record_type", "refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/warc-{uuid.uuid4().hex}"
    write(pages, path, least_bytes)
    return read(spark, path)
