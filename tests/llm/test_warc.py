import gzip
import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fabtrace.llm import warc
from fabtrace.sources.scratch import new_path

TEXT = "x" * 120
ROWS = [
    (5, "http://a/", TEXT),
    (3, "http://a/b c\r\nWARC-Type: revisit", TEXT),
    (9, None, TEXT),
    (None, "http://ä/", TEXT),
    (3, "http://a/", TEXT),  # repeated row with other url
    (1, "u", "small"),
    (2, "u", "small"),
    (4, "u", ""),
    (6, "u", None),
    (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\x1f\x00 中文 \U0001f600\r\n\r\n" * 9),
    (8, "u", "long \r\n" * 300_000),
    (None, None, "y" * 100),
    (None, None, "y" * 100),
    (10, "u", "z" * 99),
    (11, "u", "z" * 99),
]


def table(spark, rows=ROWS):
    schema = "page_id long, url string, html string, id int, payload string, digest string, first int, least int"
    return spark.createDataFrame([(*r, 1, "p", "d", 1, 1) for r in rows], schema)


def expected(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        least = first.get(html or "")
        again = len(data) >= 100 and page != least
        out[(page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least if again else None)] += 1
    return out


def read_back(spark, path):
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return Counter(tuple(r) for r in warc.pages(warc.read(spark, path), "long").select(*columns).collect())


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("archive_bytes", [1, 2000, warc.ARCHIVE_BYTES])
def test_round_trip(spark, compress, archive_bytes):
    path = new_path(spark, "archives")
    warc.write(warc.with_revisits(warc.payloads(table(spark).coalesce(2))), path, archive_bytes, compress)
    assert read_back(spark, path) == expected(ROWS)
    assert warc.quarantined(warc.read(spark, path)).count() == 0
    urls = {r.page_id: r.url for r in warc.pages(warc.read(spark, path), "long").where("page_id < 3").collect()}
    assert urls == {1: "u", 2: "u"}


def test_a_crowded_filter_changes_nothing(spark):
    path = new_path(spark, "archives")
    warc.write(warc.with_revisits(warc.payloads(table(spark)), most_cells=8), path)
    assert read_back(spark, path) == expected(ROWS)


def test_empty_table(spark):
    path = new_path(spark, "archives")
    warc.write(warc.with_revisits(warc.payloads(table(spark, []))), path)
    assert warc.read(spark, path).count() == 0
    assert read_back(spark, path) == Counter()


def test_archives_are_plain_gzip(spark):
    path = new_path(spark, "archives")
    warc.write(warc.with_revisits(warc.payloads(table(spark).coalesce(1))), path)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    text = b"".join(gzip.decompress(f) for f in files)
    assert text.count(b"\r\nWARC-Record-ID: <urn:fabtrace:page") == len(ROWS)
    assert all(warc._VERSION_LINE.match(gzip.decompress(f)) for f in files)


def test_ids_of_any_text(spark):
    ids = ["", "-", "=", "a:b\r\nc", "50% ü+ +", None, "x>"]
    df = spark.createDataFrame([(i, TEXT + str(n)) for n, i in enumerate(ids)], "page_id string, html string")
    path = new_path(spark, "archives")
    warc.write(warc.with_revisits(warc.payloads(df.withColumn("url", F.lit("u")))), path)
    back = warc.pages(warc.read(spark, path))
    assert Counter(r.page_id for r in back.collect()) == Counter(ids)


# ---- salvage ---------------------------------------------------------------------------------


def made(n, compress):
    """Bytes of n records, and where each begins."""
    parts = []
    for i in range(n):
        payload = f"page {i} ".encode() * (3 + 7 * i)
        record = warc._record(str(i), f"http://a/{i}", payload, hashlib.sha256(payload).hexdigest(), None)
        parts.append(warc._member(record) if compress else record)
    starts = [sum(map(len, parts[:i])) for i in range(n + 1)]
    return b"".join(parts), starts


def read_bytes(data):
    found = list(warc.salvage(data))
    at = 0
    for offset, length, _ in found:  # covers the whole archive
        assert offset == at
        at += length
    assert at == len(data)
    good = {o: r for o, _, r in found if not isinstance(r, str)}
    return good, [(o, n) for o, n, r in found if isinstance(r, str)]


@pytest.mark.parametrize("compress", [True, False])
def test_every_damaged_byte_costs_its_own_record_only(compress):
    data, starts = made(5, compress)
    whole, gaps = read_bytes(data)
    assert sorted(whole) == starts[:-1] and not gaps
    lost = 0
    for at in range(len(data)):
        damaged = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
        own = max(s for s in starts[:-1] if s <= at)
        good, gaps = read_bytes(damaged)
        assert all(good[s] == whole[s] for s in starts[:-1] if s != own)
        # Some bytes of a header are covered by no check; no record comes back with another payload.
        if own in good:
            assert good[own].payload == whole[own].payload
        else:
            lost += 1
            assert gaps == [(own, starts[starts.index(own) + 1] - own)]
    assert lost > len(data) * (0.97 if compress else 0.5)


@pytest.mark.parametrize("compress", [True, False])
def test_garbage_cuts_and_missing_stretches(compress):
    rng = random.Random(7)
    data, starts = made(12, compress)
    whole, _ = read_bytes(data)
    for _ in range(60):
        a, b = sorted(rng.sample(range(len(data)), 2))
        b = min(b, a + 400)
        junk = rng.choice([b"", bytes(rng.randrange(256) for _ in range(90)), b"\x1f\x8b\x08\x00" * 5 + b"U", b"WARC/1.1\r\n" * 4 + b"U"])
        good, gaps = read_bytes(data[:a] + junk + data[b:])
        shift = len(junk) - (b - a)
        untouched = [s for s, e in zip(starts, starts[1:], strict=False) if e <= a]
        moved = [s for s in starts[:-1] if s >= b]
        assert all(good[s] == whole[s] for s in untouched)
        assert all(good[s + shift] == whole[s] for s in moved)
        # A plain record can lose a piece of a header that no check covers.
        assert len(good) == len(untouched) + len(moved) or not compress


def test_reasons_and_other_writers():
    payload = b"p" * 10
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nwarc-record-id: <urn:x>\r\nWARC-Date: d\r\nX-Long: a\r\n  b\r\n"
    good = head + b"Content-Length: 10\r\n\r\n" + payload + b"\r\n\r\n"
    sha1 = head + b"WARC-Block-Digest: sha1:" + b"A" * 32 + b"\r\nContent-Length: 10\r\n\r\n" + payload + b"\r\n\r\n"
    cases = {
        b"WARC/1.1\r\nWARC-Type: response\r\n": "header does not end",
        head + b"\r\n": "no content-length",
        head + b"Content-Length: 11\r\n\r\n" + payload + b"\r\n\r\n": "block does not end where its length says",
        head + b"Content-Length: -1\r\n\r\n": "content-length is no number",
        sha1: "block digest differs",
        good.replace(b"resource", b"nonsense"): "unknown type of record",
        warc._member(good)[:-9]: "member is cut off",
        warc._member(b"no record"): "no version line",
        warc._member(b""): "empty member",
        b"nonsense": "no version line",
    }
    for damage, reason in cases.items():
        found = list(warc.salvage(damage))
        assert found == [(0, len(damage), reason)]
        at, n, record = list(warc.salvage(damage + good))[-1]
        if reason != "header does not end":
            assert (at, n) == (len(damage), len(good))
        assert record.payload == payload and record.fields["x-long"] == "a b"
    # A member may hold several records, and plain records may follow.
    mixed = warc._member(good + good) + good
    assert [r.payload for _, _, r in warc.salvage(mixed)] == [payload] * 3


def test_lost_pages_are_logged(spark, tmp_path):
    data, starts = made(4, True)
    (tmp_path / "a.warc").write_bytes(data[: starts[1] + 5] + data[starts[2] :])
    (tmp_path / "b.warc").write_bytes(b"junk")
    (tmp_path / "c.warc").write_bytes(b"")
    found = warc.read(spark, str(tmp_path))
    assert sorted(r.page_id for r in warc.pages(found).collect()) == ["0", "2", "3"]
    gaps = sorted((r.archive[-6:], r.offset, r.length) for r in warc.quarantined(found).collect())
    assert gaps == [("a.warc", starts[1], 5), ("b.warc", 0, 4)]


def test_a_revisit_of_a_lost_page_has_no_size(spark, tmp_path):
    payload = b"q" * 200
    digest = hashlib.sha256(payload).hexdigest()
    (tmp_path / "a.warc").write_bytes(warc._member(warc._record("2", None, payload, digest, "1")))
    row = warc.pages(warc.read(spark, str(tmp_path)), "long").first()
    assert (row.page_id, row.record_type, row.refers_to, row.payload_bytes, row.payload_digest) == (2, "revisit", 1, None, digest)


def test_few_large_rows_are_handed_to_python_at_a_time(spark, tmp_path, monkeypatch):
    """Pages by the hundred, archives one by one; the session's own setting is back afterwards."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(setting), []
    keep = warc.stored
    monkeypatch.setattr(warc, "stored", lambda df: seen.append(spark.conf.get(setting)) or keep(df))
    rows = spark.createDataFrame([(i, "http://x", "page %d" % i) for i in range(9)], "page_id long, url string, html string")
    warc.write(warc.with_revisits(warc.payloads(rows)), str(tmp_path / "a"), archive_bytes=1)
    assert warc.pages(warc.read(spark, str(tmp_path / "a"))).count() == 9
    assert seen[-1] == "1" and spark.conf.get(setting) == before


def test_an_archive_is_not_copied():
    whole = bytearray(b"x" * (4 << 20))
    held = pa.total_allocated_bytes()
    batch = warc._archive(whole, 1, True)
    assert pa.total_allocated_bytes() - held < 1 << 20
    assert batch.column("archive")[0].as_py() == bytes(whole)
