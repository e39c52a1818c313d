"""WARC: exact round trips, magic inside payloads, broken files, revisits."""
import base64
import gzip
import hashlib
import os

import pytest

from recsmith.llm import warc
from recsmith.llm.common import read_table


def want(rows, least=0):
    out = []
    for i, t in rows:
        t = t or ""
        same = [j for j, u in rows if (u or "") == t and j is not None]
        first = min(same, default=None)
        again = len(t.encode()) >= least and i != first and len([1 for _, u in rows if (u or "") == t]) > 1 and first is not None
        out.append((i, len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def fake(length=10):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {length}\r\n\r\n"


ODD = [(1, "plain"), (2, fake() + "0123456789\r\n\r\n" + "tail"), (3, "a\r\n\r\nb\r\n"), (4, ""), (5, None), (6, "plain"), (7, "\r\n"), (8, "\r\n\r\n"),
       (9, "x\r\n\r\n" + fake(999999)), (10, fake(0)), (11, "é" * 3), (12, "ends with cr\r"), (13, fake(10) + "0123456789"), (14, "plain"),
       (15, "WARC/1.1\r\n"), (16, "WARC/1.1\r\nContent-Length: x\r\n\r\n"), (17, "\n" * 5), (None, "no id"), (None, "plain"), (18, "big " * 100_000)]


@pytest.mark.parametrize("least", [0, 6])
def test_payloads(spark, least):
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i != 3 else None, t, "extra") for i, t in ODD], "page_id bigint, url string, html string, digest string")
    assert got(warc.round_trip(pages.coalesce(2), least)) == want(ODD, least)


def test_forged_chain_is_not_followed(spark, tmp_path):
    """Records inside a payload that line up with a real boundary stay payload."""
    pages = spark.createDataFrame([(1, "u\r\nWARC-Type: revisit", fake(4) + "abcd\r\n\r\n" + fake(3) + "abc"), (2, "u", "second")], "page_id bigint, url string, html string")
    path = str(tmp_path / "w")
    warc.write(pages.coalesce(1), path)
    found = warc.candidates(spark, path)
    assert found.count() >= 4
    assert {r.page_id for r in warc.read(spark, path).collect()} == {1, 2}


def test_pages_and_files(spark, sf, tmp_path):
    pages = read_table(spark, sf, "pages")
    path = str(tmp_path / "w")
    warc.write(pages, path, rows_per_file=40)
    assert len([f for f in os.listdir(path) if f.endswith(".gz")]) >= 6
    assert got(warc.read(spark, path)) == want([(r.page_id, r.html) for r in pages.collect()])


def test_truncated_file(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "text " * 50) for i in range(5)], "page_id bigint, url string, html string")
    path = tmp_path / "w"
    warc.write(pages.coalesce(1), str(path))
    name = next(f for f in os.listdir(path) if f.endswith(".gz"))
    data = gzip.decompress((path / name).read_bytes())
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "part-0.txt.gz").write_bytes(gzip.compress(data[:len(data) // 8]))
    with pytest.raises(ValueError, match="broken"):
        warc.read(spark, str(cut)).collect()


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(pages).collect() == []


def test_files_that_end_in_line_ends(spark, tmp_path):
    """The last payload of every file ends in line ends; cut files stay errors."""
    rows = [(1, "\r\n"), (2, "body\r\n"), (3, "a\r\n\r\n"), (4, "a\r\n\r\n\r\n"), (5, "\r\n\r\n\r\n"), (6, "x\r"), (7, "x\n"), (8, "\n\r\n"), (9, ""),
            (10, fake(4) + "abcd\r\n\r\n" + "\r\n")]
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in rows], "page_id bigint, url string, html string")
    path = str(tmp_path / "w")
    warc.write(pages.coalesce(1), path, rows_per_file=1)
    names = [f for f in os.listdir(path) if f.endswith(".gz")]
    assert len(names) == len(rows) and got(warc.read(spark, path)) == want(rows)
    for cut in (1, 2, 3, 5, 6):
        broken = tmp_path / f"cut{cut}"
        broken.mkdir()
        whole = next(gzip.decompress(open(os.path.join(path, f), "rb").read()) for f in names
                     if b"<urn:page:2>" in gzip.decompress(open(os.path.join(path, f), "rb").read()))
        (broken / "a.txt.gz").write_bytes(gzip.compress(whole[:-cut]))
        with pytest.raises(ValueError):
            warc.read(spark, str(broken)).collect()


def test_payloads_move_by_id_and_not_by_digest(spark, tmp_path, monkeypatch):
    """Without broadcasts no exchange of payloads is keyed by digest alone, which a very common payload would make one task."""
    from pyspark.sql import functions as F

    from recsmith.llm import warc
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"),
                                        F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("p"), (F.col("id") % 50).cast("string"))).alias("html"))
        written = []
        monkeypatch.setattr(warc, "_record", lambda kind: written.append(kind) or F.concat(F.lit(kind), F.col("payload")))
        plans = []
        real = warc.materialize
        monkeypatch.setattr(warc, "materialize", lambda df, name: plans.append(df) or real(df, name))
        warc.write(pages, str(tmp_path / "w"))
        assert written and plans[0].columns == ["again_id", "again_digest", "first_id"]
        kinds = [r.value for r in spark.read.text(str(tmp_path / "w")).collect() if r.value.startswith("re")]
        assert len(kinds) == 300 and sum(k.startswith("response") for k in kinds) == 1 + len({i % 50 for i in range(300) if i % 3})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
