import hashlib
import io
import zipfile

import pytest

from tracery.llm import zip_warc as z


def reader(data):
    return lambda at, n: data[at : at + n]


@pytest.mark.parametrize("zip64", [True, False])
def test_packages_are_plain_zip_files(zip64):
    members = [("a/b.txt", b"x" * 1000), ("é", b"")]
    data = z.zip_stored(members, zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as f:
        assert f.testzip() is None and [(n, f.read(n)) for n in f.namelist()] == members
    entries = z.central_directory(reader(data), len(data))
    for name, held in members:
        at, n = z.stored_member(reader(data), entries[name])
        assert data[at : at + n] == held


def test_reads_a_package_another_writer_made():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        f.comment = b"PK comment"
        with f.open("m", "w", force_zip64=True) as m:
            m.write(b"hello")
    data = out.getvalue()
    at, n = z.stored_member(reader(data), z.central_directory(reader(data), len(data))["m"])
    assert data[at : at + n] == b"hello"


def test_round_trip_against_brute_force(spark):
    big, small = "<p>" + "é" * 60, "tiny"
    rows = [(5, "u", big), (3, "u\r\nWARC-Type: x", big), (9, None, big), (1, "u", small), (2, "u", small), (7, "u", None), (8, "u", ""), (None, "u", big), (4, "u", "y" * 3_000_000), (6, "u", "a\r\n\r\nb" * 30)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    archives = z.write_archives(pages)
    found = {r.page_id: r for r in z.read_archives(archives, payloads=True).collect()}
    assert len(found) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 3
        r = found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert r.payload == (b"" if revisit else data)
    assert z.archive_round_trip(pages.limit(0)).count() == 0
