import base64
import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest
from helpers import F

from tallyloom.llm import warc
from tallyloom.plans.small import run_folder

PAGES = "page_id long, url string, html string, record_type string, payload binary"


def write(spark, rows, **options):
    path = run_folder(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([(i, u, h, "x", b"y") for i, u, h in rows], PAGES), path, **options)
    return path


def read(spark, path):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                   for r in warc.read_warc(spark, path).collect()), key=str)


def expected(rows, min_payload=0):
    ids = defaultdict(list)
    for i, _, h in rows:
        ids[h or ""].append(i)
    out = []
    for i, _, h in rows:
        payload, same = (h or "").encode(), [x for x in ids[h or ""] if x is not None]
        first = max(same, default=None)
        again = len(ids[h or ""]) > 1 and len(payload) >= min_payload and first is not None and i != first
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}

    def limit(size):
        for k, v in keys.items():
            spark.conf.set(k, v if "max" not in k else str(size))

    yield limit
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_round_trip(spark, small_ranges):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}\r\nX: y", rng.choice(["the same", None, "x" * rng.randrange(40), "".join(
        chr(rng.randrange(32, 900)) for _ in range(rng.randrange(3000)))])) for i in range(120)]
    rows += [(None, None, "y"), (None, "v", "the same"), (900, "u", None), (900, "u", None), (901, "w", "z" * 500_000)]
    path = write(spark, rows)
    small_ranges(2000)
    assert read(spark, path) == expected(rows)
    texts = {r["page_id"]: r["payload"] for r in warc.read_warc(spark, path).where("record_type = 'response'").collect()}
    assert all(texts[i] == (h or "").encode() for i, _, h in rows if i in texts and i is not None and i < 120)


def test_small_payloads_are_not_revisited(spark):
    rows = [(1, "a", "abc"), (2, "b", "abc"), (3, "c", "abcd"), (4, "d", "abcd")]
    assert read(spark, write(spark, rows, min_payload=4)) == expected(rows, 4)


def test_empty_table(spark):
    assert read(spark, write(spark, [])) == []


@pytest.mark.parametrize("size", [500, 3000, 1 << 20])
def test_magic_inside_members(spark, small_ranges, tmp_path, size):
    """Stored members whose payload is full of the magic, over ranges smaller than a record."""
    rng, data, rows = random.Random(size), b"", []
    for i in range(50):
        payload = b"".join(rng.choice([warc.MAGIC, warc.MAGIC + b"\x00" * 7, b"abc" * rng.randrange(400)]) for _ in range(rng.randrange(20)))
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        data += packer.compress(warc.record_bytes(i, "u", payload, None, False, "d")) + packer.flush()
        data += zlib.compress(b"no record", wbits=31) if i % 9 == 0 else b""
        rows.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response", None))
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "x.warc.gz.bin").write_bytes(data)
    small_ranges(size)
    assert read(spark, f"file://{tmp_path}/in") == sorted(rows, key=str)


def archive(records):
    return b"".join(zlib.compress(r, wbits=31) for r in records)


def answers(n, seed=1):
    rng = random.Random(seed)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(3000))) for _ in range(n)]
    rows = [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response", None) for i, p in enumerate(payloads)]
    return [warc.record_bytes(i, "u", p, None, False, "d") for i, p in enumerate(payloads)], rows


@pytest.mark.parametrize("name", ["a.warc.gz", "CC-MAIN-0001.gz", "a.gz", "x.WARC.gz", "1.gz", "-.gz"])
def test_names_that_end_in_gz(spark, small_ranges, tmp_path, name):
    """They are neither decompressed by their names nor read in one piece."""
    records, rows = answers(40)
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / name).write_bytes(archive(records))
    small_ranges(4000)
    found = warc.read_warc(spark, f"file://{tmp_path}/in")
    assert read(spark, f"file://{tmp_path}/in") == sorted(rows, key=str)
    raw = spark.read.options(**warc._RAW_GZ).text(f"file://{tmp_path}/in")
    assert raw.select(F.spark_partition_id()).distinct().count() > 5
    assert found.columns == [f.split()[0] for f in warc.RECORD.split(", ")]


@pytest.mark.parametrize("size", [700, 4000, 1 << 20])
def test_damaged_members_are_counted(spark, small_ranges, tmp_path, size):
    """Bytes changed in the body, in the magic's method or cut off at the end: each is one row, and no other record suffers."""
    records, rows = answers(30)
    packed = [bytearray(zlib.compress(r, wbits=31)) for r in records]
    packed[4][len(packed[4]) // 2] ^= 0xFF
    packed[11][3] |= 0xE0  # reserved flags: the header does not decode
    packed[29] = packed[29][:-9]
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(packed))
    small_ranges(size)
    got = warc.read_warc(spark, f"file://{tmp_path}/in").collect()
    assert sorted(r["page_id"] for r in got if r["record_type"] == "response") == [i for i in range(30) if i not in (4, 11, 29)]
    bad = [r for r in got if r["record_type"] == warc.DAMAGED]
    assert sorted(bytes(r["payload"]) for r in bad) == sorted(bytes(packed[k]) for k in (4, 11, 29))
    assert all(r["payload_bytes"] == len(r["payload"]) and r["page_id"] is None for r in bad)


def test_headers_in_any_case_and_other_types():
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    lower = b"WARC/1.0\r\nwarc-type:response\r\nwarc-record-id: <urn:x-page:7>\r\nCONTENT-LENGTH: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    assert warc.parse_record(lower)[:2] == (7, "response") and warc.parse_record(lower)[-1] == b"hello"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\na: 1\r\n\r\nb\r\n\r\n"
    assert warc.parse_record(info)[1] == "warcinfo" and warc.parse_record(info)[-1] == b"a: 1\r\n\r\nb"
    for broken in (b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx", b"WARC/1.0\r\nContent-Length: 1\r\n\r\nx", b"WARC/1.0",
                   b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nx", lower.replace(b"CONTENT-LENGTH: ", b"Content-Length: -")):
        assert warc.parse_record(broken) == (None, "damaged", None, None, len(broken), None, broken)


def test_revisits_point_to_the_largest_id(spark):
    path = write(spark, [(i, "u", "same" if i % 2 else str(i)) for i in range(20)])
    revisits = warc.read_warc(spark, path).where("record_type = 'revisit'")
    assert {(r["page_id"], r["refers_to"]) for r in revisits.collect()} == {(i, 19) for i in range(1, 19, 2)}


def test_members_end_in_zero():
    for size in (0, 1, 1000, (1 << 24) - 1, 1 << 24, 1 << 25):
        packed = warc.member(b"a" * size)
        assert packed[-1] == 0 and zlib.decompressobj(31).decompress(packed) == b"a" * size
