import gzip
import hashlib
import random
from base64 import b32encode
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkwatch.llm import warc

SCHEMA = "page_id long, url string, html string, captured string, digest string, refers_to int, salt int, n int"


def test_loser_tree_merges():
    rng = random.Random(6)
    for k in range(0, 14):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_members():
    parts = [b"", b"a" * 100_000, b"", bytes(range(256)) * 300, b"x", b""]
    data = b"".join(gzip.compress(p) for p in parts)
    found = list(warc.members(data))
    assert [c for _, _, c in found] == [p for p in parts if p]
    assert all(gzip.decompress(data[o : o + n]) == c for o, n, c in found)
    with pytest.raises((ValueError, Exception)):
        list(warc.members(data[:-30]))


def test_records():
    for payload, refers, revisit in ((b"", None, False), ("é\r\n\r\nWARC/1.1\r\n".encode() * 3, None, False), (b"abc", 5, True)):
        fields, got = warc.parse_record(warc.record(7, "http://x.org/a b\r\nc?é", "2024-01-01T00:00:00Z", payload, refers, revisit))
        assert got == (b"" if revisit else payload) and fields["WARC-Record-ID"] == "<urn:page:7>"
        assert int(fields["X-Payload-Bytes"]) == len(payload) and "\r" not in fields["WARC-Target-URI"]
    broken = warc.record(7, None, "d", b"abc", None, False).replace(b"abc", b"abd")
    with pytest.raises(ValueError):
        warc.parse_record(broken)


@pytest.mark.parametrize("url, key", [("http://www.A.org/x?q=1", "org,a)/x?q=1"), ("https://b.c.d:444", "d,c,b:444)/"), (None, ""), ("http://[bad", "http://[bad")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def pages():
    rng = random.Random(9)
    rows = []
    for i in range(300):
        html = rng.choice([f"<p>{i}</p>", f"<p>{i % 7}</p>", "hot", "hot", None, ""])
        rows.append((i, rng.choice([None, "http://a.org/", "http://b.a.org/x", f"http://c.net/{i % 5}", "::"]), html, f"2024-01-{i % 28 + 1:02d}T00:00:00Z"))
    rows += [(None, "http://a.org/", "hot", "2024-01-01T00:00:00Z"), (None, None, "only without id", "2024-01-01T00:00:00Z"),
             (None, None, "only without id", "2024-01-01T00:00:00Z")]
    first = min(i for i, _, h, _ in rows if h == "hot" and i is not None)
    rows += [r for r in rows if r[0] == first]  # the response itself, repeated
    rows += [(400, "http://z.org/", "long " * 300_000, "2024-01-01T00:00:00Z")]
    return rows


@pytest.mark.parametrize("broadcast_rows, min_bytes", [(100_000, 0), (0, 0), (100_000, 5)])
def test_archives_and_index(spark, tmp_path, monkeypatch, broadcast_rows, min_bytes):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast_rows)
    rows = pages()
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(6)
    warc.write_archives(frame, str(tmp_path / "w"), min_bytes)
    stored = warc.materialize(warc.runs(spark, str(tmp_path / "w")), "test-runs")
    got = warc.merge_runs(stored, range_rows=37).collect()
    keys = [warc.sort_key(r.asDict()) for r in got]
    assert keys == sorted(keys) and len(keys) == len(rows)
    # each entry reads its record alone
    for r in got[::17]:
        data = (tmp_path / "w" / r["archive"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert warc.parse_record(gzip.decompress(data))[0]["WARC-Date"] == r["captured"]
    by = defaultdict(list)
    for i, _, html, _ in rows:
        by[(html or "").encode()].append(i)
    want = Counter()
    for payload, ids in by.items():
        known = [i for i in ids if i is not None]
        first = min(known) if known and len(payload) >= min_bytes else None
        digest = b32encode(hashlib.sha1(payload).digest()).decode()
        responded = False
        for i in ids:
            revisit = first is not None and (i != first or responded)
            responded |= i == first and first is not None
            want[i, len(payload), digest, "revisit" if revisit else "response", first if revisit else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want


def test_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], SCHEMA)
    warc.write_archives(frame, str(tmp_path / "w"))
    assert warc.capture_index(spark, str(tmp_path / "w")).count() == 0
    one = spark.range(1).select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.lit("d").alias("captured"))
    warc.write_archives(one, str(tmp_path / "v"))
    assert [r["payload_bytes"] for r in warc.capture_index(spark, str(tmp_path / "v")).collect()] == [0]
