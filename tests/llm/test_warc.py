import base64
import hashlib
import io
import zipfile

import pytest

from heatgrid.llm import common, warc

PAGES = "page_id long, url string, html string, size int"


def brute(rows, min_bytes=0):
    out = []
    for i, _, html in rows:
        own = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == own and j is not None]
        first = min(same) if same and len(own) >= min_bytes else None
        refers = first if first is not None and i != first else None
        out.append((i, len(own), base64.b32encode(hashlib.sha1(own).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


ROWS = [(5, "http://a/\r\nX: y", "same"), (3, "http://b", "same"), (9, None, "same"), (4, "http://c", None), (6, "http://d", ""), (7, "http://e", "é\r\n\r\nWARC/1.1\r\n"), (8, "http://f", "z" * 3_000_000), (3, "http://b", "same"), (None, "n", "own"), (None, "n", "same")]


@pytest.mark.parametrize(("min_bytes", "package", "range_"), [(0, warc.PACKAGE_BYTES, warc.RANGE_BYTES), (1, 10, 10)])
def test_records_come_back(spark, tmp_path, min_bytes, package, range_):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], PAGES).repartition(2)
    packages = warc.write_packages(pages, f"file://{tmp_path}/w", min_bytes, package)
    rows = warc.read_packages(packages, range_bytes=range_).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == brute(ROWS, min_bytes)
    for r in rows:
        if r.record_type == "response":
            assert bytes(r.payload) in [(h or "").encode() for i, _, h in ROWS if i == r.page_id]
    urls = {r.page_id: r.url for r in rows}
    assert urls[5] == "http://a/%0D%0AX: y" and urls[9] is None
    for p in packages.collect():  # others can read them too
        assert zipfile.ZipFile(p.path.removeprefix("file://")).testzip() is None


def test_broadcast_and_shuffled_joins_agree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MAX_BROADCAST_ROWS", -1)
    monkeypatch.setattr(common, "HOT_ROWS", 2)  # the empty and the frequent payloads are dealt
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], PAGES)
    rows = warc.read_packages(warc.write_packages(pages, f"file://{tmp_path}/w"), with_payload=False).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == brute(ROWS)


def test_reads_are_dealt_over_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, f"page {i} " + hashlib.sha256(str(i).encode()).hexdigest() * 40, 1) for i in range(50)], PAGES)
    packages = warc.write_packages(pages, f"file://{tmp_path}/w")
    read = warc.read_packages(packages, with_payload=False, range_bytes=1)  # a range for each record
    read.write.parquet(f"file://{tmp_path}/read")
    parts = [p for p in (tmp_path / "read").glob("part-*.parquet")]
    assert len(parts) == spark.sparkContext.defaultParallelism > 1
    assert spark.read.parquet(f"file://{tmp_path}/read").count() == 50


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], PAGES)
    assert warc.read_packages(warc.write_packages(pages, f"file://{tmp_path}/w")).count() == 0


def zipped(entries, n_fake=0, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries.items():
            with z.open(name, "w", force_zip64=True) as f:
                f.write(data)
        for i in range(n_fake):
            z.writestr(f"x{i}", b"")
        z.comment = b"a comment"
    return out.getvalue()


@pytest.mark.parametrize("n_fake", [0, 70_000])  # more than 65,535 members need ZIP64 end records
def test_directories(n_fake):
    data = zipped({"a": b"first", "b": b"second" * 100}, n_fake)
    read = lambda offset, length: data[offset : offset + length]
    entries = warc.directory(read, len(data))
    assert len(entries) == 2 + n_fake
    at, size = warc.locate(read, entries, "b")
    assert data[at : at + size] == b"second" * 100
    assert warc.locate(read, entries, "a")[1] == 5


def test_compressed_members_are_refused():
    data = zipped({"a": b"first" * 50}, method=zipfile.ZIP_DEFLATED)
    read = lambda offset, length: data[offset : offset + length]
    with pytest.raises(ValueError, match="compressed"):
        warc.locate(read, warc.directory(read, len(data)), "a")


def test_a_central_directory_with_64_bit_offsets():
    import struct

    extra = struct.pack("<HHQQQ", 1, 24, 7 << 32, 6 << 32, 5 << 32)
    central = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"m" + extra
    far = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), 0)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(central), 1)
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = central + far + locator + end
    assert warc.directory(lambda o, n: data[o : o + n], len(data)) == {"m": (0, 5 << 32, 6 << 32)}
