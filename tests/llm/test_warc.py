import hashlib
import os

from planweave.llm import warc

PAGES = "page_id long, url string, html string, size string"


def test_revisits_and_nulls_read_back(spark):
    big = "<p>" + "é" * 600
    rows = [(1, "http://a/ b", big, "x"), (2, "u", big, "x"), (5, None, big, None), (3, "u", None, "y"), (4, "u", "", "z"), (None, "u", big, "q"), (6, "u", "small", ""), (7, "u", "small", "")]
    got = {r.page_id: r for r in warc.archive_and_read(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == len(rows)
    for i in (1, 2, None):
        assert (got[i].record_type, got[i].refers_to) == ("revisit", 5)
    assert got[5].record_type == got[6].record_type == got[7].record_type == "response"
    assert all(got[i].payload_bytes == 1203 and got[i].payload_digest == hashlib.sha1(big.encode()).hexdigest() for i in (1, 2, 5, None))
    assert got[3].payload_bytes == got[4].payload_bytes == 0
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def archive(tmp_path, compress, n=60):
    rows = [warc.record("response", i, f"u{i}", os.urandom(500 + i) + b"WARC/1.1\r\n", "00" * 20, 0, None) for i in range(n)]
    fixed = []
    for i, r in enumerate(rows):  # the payload digest that was written as zeros
        payload = r[r.index(b"HTTP/1.1") :][:-4]
        payload = payload[payload.index(b"\r\n\r\n") + 4 :]
        fixed.append(warc.record("response", i, f"u{i}", payload, hashlib.sha1(payload).hexdigest(), len(payload), None))
    import zlib

    data, starts = b"", []
    for r in fixed:
        starts.append(len(data))
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        data += z.compress(r) + z.flush() if compress else r
    path = str(tmp_path / ("a.warc" + ".gz" * compress))
    return path, bytearray(data), starts


def read(spark, path, step):
    frame = spark.createDataFrame([(path, os.path.getsize(path))], "path string, size long")
    rows = warc.read_warc(frame, range_bytes=step).collect()
    return sorted(int(warc.key_of(r.record_id)) for r in rows if r.kind == "record"), sorted((r.start, r.end) for r in rows if r.kind == "gap")


def test_salvage_goes_on_after_damage(spark, tmp_path):
    for compress in (True, False):
        path, data, starts = archive(tmp_path, compress)
        data[starts[7] + 300] ^= 255  # one byte of a record
        del data[starts[20] + 450 : starts[23] + 460]  # a hole over several
        cut = starts[23] + 460 - starts[20] - 450
        data = data[: len(data) - 30]  # the last one cut short
        open(path, "wb").write(data)
        want = [i for i in range(59) if i not in (7, 20, 21, 22, 23)]
        gaps = [(starts[7], starts[8]), (starts[20], starts[24] - cut), (starts[59] - cut, len(data))]
        for step in (10**9, 4000, 997):
            assert read(spark, path, step) == (want, gaps), (compress, step)


def test_a_file_without_records_is_one_gap(spark, tmp_path):
    path = str(tmp_path / "x.warc.gz")
    open(path, "wb").write(b"\x1f\x8b\x08 nothing WARC/1. here" * 50)
    assert read(spark, path, 200) == ([], [(0, os.path.getsize(path))])


def test_a_long_url_is_read_back(spark, tmp_path):
    url = "data:text/plain," + "a b" * 33_334
    got = warc.archive_and_read(spark.createDataFrame([(1, url, "<p>one", ""), (2, "u", "<p>two", "")], PAGES)).collect()
    assert sorted(r.page_id for r in got) == [1, 2]
    digest = hashlib.sha1(b"x").hexdigest()
    data = b"".join(warc.record("response", i, url if i == 1 else "u", b"x", digest, 1, None) for i in range(3))
    path = str(tmp_path / "long.warc")
    open(path, "wb").write(data)
    assert read(spark, path, 10**9) == ([0, 1, 2], [])
