import io
import zipfile

import pytest

from prefengine.llm import warc
from prefengine.session import shared_dir


def rows(df):
    return sorted((str(r.page_id), str(r.url), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def expected(pages, least=0):
    first, out = {}, []
    for k, (i, url, html) in enumerate(sorted(pages, key=lambda p: (p[0] is None, p[0] or 0, p[1] is not None, p[1] or ""))):
        data = (html or "").encode()
        own = data if len(data) >= least else (data, k)
        out.append((str(i), str(url), len(data), warc.digest_of(data), "revisit" if own in first else "response", first.get(own)))
        first.setdefault(own, i)
    return sorted(out, key=str)


PAGES = [(5, "http://a/ö b\n", "<p>same"), (3, "http://b", "<p>same"), (9, None, "<p>same"), (1, "u", None), (2, "u", ""), (4, "u", "x" * 300_000),
         (3, "http://b", "<p>same"), (7, "u", "\x00\r\n\r\nbody é 𝄞"), (None, "n", "<p>same"), (None, "m", "alone")]


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, record_type string, sha int").repartition(3)
    got = rows(warc.archive_and_read(df, min_revisit_bytes=least, package_bytes=100_000))
    assert sorted(got, key=str) == expected(PAGES, least)
    full = {r.page_id: r.payload for r in warc.archive_and_read(df, payloads=True).filter("record_type = 'response' and page_id is not null").collect()}
    assert full[4] == b"x" * 300_000 and full[7] == "\x00\r\n\r\nbody é 𝄞".encode() and full[1] == b""


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_directory(zip64):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        with z.open("a.bin", "w", force_zip64=zip64) as m:
            m.write(b"first" * 100)
        z.writestr("dir/b.bin", b"second")
        z.writestr(zipfile.ZipInfo("c"), b"z" * 999, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    p = warc.Package(data, len(data.getvalue()))
    assert p.read(*p.place("a.bin")) == b"first" * 100 and p.read(*p.place("dir/b.bin")) == b"second"
    with pytest.raises(ValueError):
        p.place("c")


def test_zip64_end_record_and_extra_fields(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", allowZip64=True) as z:
        for k in range(5):
            with z.open(f"m{k}", "w", force_zip64=True) as m:
                m.write(b"%d" % k * 200)
    raw = data.getvalue()
    assert b"PK\x06\x06" in raw and b"PK\x06\x07" in raw
    p = warc.Package(data, len(raw))
    assert [p.read(*p.place(f"m{k}")) for k in range(5)] == [b"%d" % k * 200 for k in range(5)]


def test_broken_files(spark):
    with pytest.raises(ValueError):
        warc.Package(io.BytesIO(b"no zip at all"), 13)
    with pytest.raises(ValueError):
        warc.parse_record(b"HTTP/1.1 200 OK\r\n\r\n")
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
