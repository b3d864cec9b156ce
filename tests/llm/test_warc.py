import base64
import gzip
import hashlib

from poolframe.llm import warc
from poolframe.llm.store import fresh_path

SCHEMA = "page_id long, url string, html string, digest string, type int"


def expected(pages, least=0):
    first = {}
    for page_id, _, html, *_ in pages:
        body = html or ""
        if len(body.encode()) >= least and page_id is not None:
            first[body] = min(first.get(body, page_id), page_id)
    out = set()
    for page_id, _, html, *_ in pages:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        holder = first.get(html or "") if len(body) >= least else page_id
        again = holder is not None and holder != page_id
        out.add((page_id, len(body), digest, "revisit" if again else "response", holder if again else None))
    return out


PAGES = [
    (3, "http://a/x", "<p>one</p>", "d", 1),
    (1, "http://a/y z\r\nWARC-Type: fake", "<p>one</p>", "d", 1),
    (2, None, None, "d", 1),
    (7, "http://b", "", None, None),
    (4, "http://c", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n", "d", 1),
    (5, "http://d", "ü€😀" * 50_000, "d", 1),
    (6, "http://e", "\r\n\r\n\n", "d", 1),
    (None, "http://f", "<p>one</p>", "d", 1),
    (8, "http://a/x", "<p>one</p>", "d", 1),
]


def rows(df):
    return {tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    assert rows(warc.round_trip(pages)) == expected(PAGES)
    assert warc.round_trip(pages).count() == len(PAGES)
    assert rows(warc.round_trip(pages, least_bytes=5)) == expected(PAGES, 5)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_repeated_pages_are_captures_of_their_own(spark):
    pages = [PAGES[0]] * 3 + [PAGES[1]] * 2 + [PAGES[3]] * 2
    got = sorted(warc.round_trip(spark.createDataFrame(pages, SCHEMA).repartition(2)).select("page_id", "record_type", "refers_to").collect())
    # Rows that repeat the smallest key of a payload all hold it.
    assert [tuple(r) for r in got] == [(1, "response", None)] * 2 + [(3, "revisit", 1)] * 3 + [(7, "response", None)] * 2


def test_a_payload_of_most_pages(spark, monkeypatch):
    from poolframe.llm import store

    monkeypatch.setattr(store, "HOT_KEYS", 3)
    monkeypatch.setattr(warc, "FILE_BYTES", 4)
    pages = [(i, f"http://{i}", "<p>error</p>" if i % 2 else f"<p>{i // 4}</p>", "d", 1) for i in range(60)]
    assert rows(warc.round_trip(spark.createDataFrame(pages, SCHEMA))) == expected(pages)


def test_nested_captures(spark):
    pages = spark.createDataFrame(PAGES[:2], SCHEMA)
    path = fresh_path(spark, "warc-test")
    warc.write(pages, path)
    records = warc.read(spark, path, with_payload=True)
    assert records.count() == 6
    got = {r.metadata.fields["page-id"]: r for r in warc.assemble(records).collect()}
    assert bytes(got["1"].main.payload) == b"<p>one</p>" and got["3"].main.type == "revisit" and got["3"].main.payload is None
    assert got["1"].request.concurrent_to == got["1"].main.record_id == got["1"].metadata.concurrent_to
    assert got["1"].uri == "http://a/y%20z%20WARC-Type:%20fake"


def test_reads_members_and_plain_files():
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    for content in (record * 3, gzip.compress(record) * 3, gzip.compress(record * 3)):
        assert [b for _, b in warc._parse(content)] == [b"hi"] * 3
