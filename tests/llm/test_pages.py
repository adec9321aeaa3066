"""Archives by round trip, URL verdicts on small tables."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import url_reputation, warc

BIG = "<p>" + "x" * 200 + "</p>"
ROWS = [(4, "http://a/\r\nX: y", BIG), (2, None, BIG), (9, "http://b", BIG), (2, "http://c", BIG), (1, "u", "short"),
        (3, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", BIG), (7, "u", "é\r\n\r\nWARC/1.1\r\n\r\n" * 30),
        (8, "u", "é\r\n\r\nWARC/1.1\r\n\r\n" * 30), (10, "u", "y" * 3_000_000), (11, "u", "\x00\ud7ff")]


def expected(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        first = min(same) if same and len(body) >= 100 else None
        refers = first if page is not None and first is not None and page != first else None
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_archive(spark, shared, parts):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, offset int").repartition(parts)
    folder = f"file://{shared}/warc"
    got = warc.archive_pages(pages, folder=folder).drop("uri").collect()
    assert sorted(map(tuple, got), key=repr) == expected(ROWS)
    for path in (shared / "warc" / "records").glob("*.warc.gz"):
        index = (path.parent / (path.name + ".idx")).read_text().splitlines()
        raw = path.read_bytes()
        for number, line in enumerate(index):
            _, n, offset, size = line.split(",")
            member = gzip.decompress(raw[int(offset):int(offset) + int(size)])
            assert int(n) == number and member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
        assert sum(int(line.split(",")[3]) for line in index) == len(raw)
    assert warc.archive_pages(pages.limit(0)).collect() == []


def test_streams_of_several_members(tmp_path):
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n" for b in (b"", b"a" * 70_000, b"\r\n\r\n")]
    for packed in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        path = tmp_path / "x"
        path.write_bytes(packed)
        with open(path, "rb") as source:
            assert list(warc._members(source)) == records
    path.write_bytes(gzip.compress(records[1])[:-40])
    with open(path, "rb") as source, pytest.raises((ValueError, EOFError)):
        list(warc._members(source))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def test_url_rules(spark, shared):
    urls = {1: "http://a.EXAMPLE.net/en/x?q", 2: "http://example.net/EN/", 3: "x://notexample.com/de/", 4: "http://example.com/de/#a",
            5: "http://a.net", 6: None, 7: "no scheme", 8: "http://b.org/fr/a://c", 9: "://", 10: "http://É.net/", 11: "http://h?x/y"}
    pages = spark.createDataFrame([(k, u, "low") for k, u in urls.items()], "page_id long, url string, mean string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: tuple(r)[1:] for r in url_reputation.judge_urls(pages, none, RULES).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "/EN/", "net/", "block"),
        3: ("notexample.com", "/de/", None, "allow"), 4: ("example.com", "/de/", "example.com/de/", "block"),
        5: ("a.net", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("b.org", "/fr/a://c", "org/fr/", "allow"), 9: ("", "", None, "allow"), 10: ("É.net", "/", "net/", "block"),
        11: ("h", "", None, "allow")}
    assert url_reputation.judge_urls(pages.limit(0), none, RULES).collect() == []


def test_reputation_shrinks(spark, shared):
    hosts = spark.createDataFrame(
        [("bad.spam.com", 40, 40), ("new.spam.com", 0, 0), ("one.spam.com", 1, 0), ("good.fine.org", 60, 1),
         ("new.fine.org", 0, 0), ("u@x.fine.org:80", 1, 1)], "host string, n long, bad long")
    got = {r.host: r for r in url_reputation.host_reputation(hosts).collect()}
    assert got["bad.spam.com"].mean > got["new.spam.com"].mean > got["one.spam.com"].mean > got["good.fine.org"].mean
    assert got["new.spam.com"].mean > got["new.fine.org"].mean and got["bad.spam.com"].low > 0.5 > got["good.fine.org"].high
    assert got["u@x.fine.org:80"].low < got["u@x.fine.org:80"].mean < got["u@x.fine.org:80"].high


def test_verdict_by_reputation_and_edges(spark, shared):
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.x{i % 2}.com/{i}") for i in range(200)] + [(None, "http://h1.x1.com/")] * 2,
                                  "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i % 2 == 1) for i in range(150)] + [(1, False), (None, True), (2, None)],
                                     "page_id long, bad boolean")
    rows = url_reputation.judge_urls(pages, outcomes, RULES).collect()
    assert len(rows) == 202 and {(r.host, r.verdict) for r in rows} == {("h1.x1.com", "block"), ("h0.x0.com", "allow")}
    assert pages.select(F.count("*")).first()[0] == 202
