"""WARC archives with payload deduplication, and a globally ordered index of their captures.

Writing: of the pages with equal payloads of at least ``min_bytes`` bytes, the one with the
smallest id becomes a ``response`` record, the others ``revisit`` records without payload.
Each record is a gzip member of its own, so an index entry (offset, length) reads it alone.
Spark's text writer commits the archives: the "lines" are whole members, the line separator
is an empty gzip member, which readers skip. A retried task therefore leaves no second copy.

Indexing is an external merge: every archive's captures are sorted into a run (by URL key,
timestamp, id), runs are stored as blocks, splitters are drawn evenly from the blocks (a
bounded number), each block is cut at the splitters, the pieces of a key range meet in one
task, and a loser tree merges the runs there. Ranges follow each other in key order, so the
result is globally ordered: the capture history of each URL, oldest first. A hot URL is cut
as well, since splitters are whole keys (URL key, timestamp, id, run, place in the run).

Defined cases: null html: an empty payload; a null url: no target URI, an empty URL key; a
null id is never referred to: it revisits the payload's smallest id if there is one, else it
is a response; rows with the same id and payload: one is the response, the others revisit
it; an empty table gives empty archives and an empty index; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, partitions, prepare, require_columns

MIN_BYTES = 0
#: Records of an archive at most; zlib level; rows of the refers-to table that may be broadcast.
ARCHIVE_RECORDS, LEVEL, BROADCAST_ROWS = 5_000, 4, 100_000
#: Entries of a block and of a merged range, and keys that the driver may sample.
BLOCK, RANGE_ROWS, SAMPLED_KEYS = 1_000, 20_000, 100_000
SALTS = 32

_EMPTY_MEMBER = zlib.compress(b"", 0, wbits=31)
ENTRY = ("url_key string, captured string, page_id long, payload_bytes long, payload_digest string, "
         "record_type string, refers_to long, archive string, place long, offset long, length long")
_ENTRY_TYPE = pa.struct([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in ENTRY.split(", "))])
_KEY = ("url_key", "captured", "page_id", "archive", "place")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The URL with its host reversed: ``http://www.a.org/x?q`` is ``org,a)/x?q``. What can't be
    split is its own key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    port = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


# ---- writing


def record(page_id: int | None, url: str | None, captured: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, without compression."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {captured}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URI_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    head.append(f"X-Payload-Bytes: {len(payload)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


#: Printable ASCII stays as it is in a target URI; the rest is percent-encoded.
_URI_SAFE = "".join(map(chr, range(33, 127)))


def _members(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            rows = zip(*(batch.column(c) for c in ("page_id", "url", "captured", "html", "refers_to", "revisit")))
            for row in rows:
                z = zlib.compressobj(level, wbits=31)
                out.append(z.compress(record(*(v.as_py() for v in row))) + z.flush())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    return run


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` (page_id, url, captured, html as bytes) with ``revisit`` and ``refers_to``. Only
    (digest, id) rows are grouped; pages meet the few digests that occur twice in a broadcast
    of checked size, or else in a join that salts each digest."""
    spark = pages.sparkSession
    keyed = pages.withColumn("digest", F.unhex(F.sha1("html"))).withColumn("large", F.length("html") >= min_bytes)
    ids = keyed.where("large").groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = ids.groupBy("digest").agg(
        F.sum("n").alias("all"), F.min("page_id").alias("first"),
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n")))["n"].alias("n_first"))
    firsts = materialize(firsts.where("all > 1 and first is not null").drop("all"), "warc-firsts")
    size = firsts.agg(F.count(F.lit(1)).alias("n"), F.max("n_first").alias("m")).first()
    if size["n"] == 0:
        return keyed.select("page_id", "url", "captured", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    if size["n"] <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(firsts), "digest", "left")
    else:
        salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = keyed.withColumn("salt", salt).join(salted, ["digest", "salt"], "left").drop("salt")
    joined = joined.withColumn("first", F.when(F.col("large"), F.col("first")))
    own = F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    out = ["page_id", "url", "captured", "html", "refers_to", "revisit"]
    plain = joined.withColumn("revisit", F.col("first").isNotNull() & ~own).withColumn("refers_to", F.when(F.col("revisit"), F.col("first")))
    if size["m"] == 1:
        return plain.select(out)
    # an id that occurs several times with its payload: one of these rows is the response
    twice = own & (F.col("n_first") > 1)
    among = Window.partitionBy("digest", "page_id").orderBy("captured", "url")
    repeated = (joined.where(twice).withColumn("revisit", F.row_number().over(among) > 1)
                .withColumn("refers_to", F.when(F.col("revisit"), F.col("first"))))
    return plain.where(~F.coalesce(twice, F.lit(False))).select(out).unionByName(repeated.select(out))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, level: int = LEVEL) -> None:
    """Writes pages (page_id, url, captured ISO time, html) as archives into the folder ``path``."""
    require_columns(pages, "page_id", "url", "captured", "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "captured",
                        F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    members = decide(rows, min_bytes).mapInArrow(_members(level), "member binary")
    (members.select(F.col("member").cast("string").alias("value")).write
     .option("lineSep", _EMPTY_MEMBER.decode("iso-8859-1")).option("encoding", "iso-8859-1").option("compression", "none")
     .option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path))


# ---- reading


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of the gzip members that aren't empty."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out, end = zlib.decompressobj(31), [], at
        while not z.eof:
            chunk = view[end : end + 16_384]
            if not len(chunk):
                raise ValueError(f"the archive ends inside the member at {at}")
            out.append(z.decompress(chunk))
            end += len(chunk) - len(z.unused_data)
        if any(out):
            yield at, end - at, b"".join(out)
        at = end


def parse_record(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record; the digest of a response is checked."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
        raise ValueError(f"the payload of {fields.get('WARC-Record-ID')} doesn't have its digest")
    return fields, payload


def _id(text: str | None) -> int | None:
    return int(text.removeprefix("<urn:page:").rstrip(">")) if text else None


def sort_key(e: dict) -> tuple:
    return (e["url_key"], e["captured"], e["page_id"] is not None, e["page_id"] or 0, e["archive"], e["place"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            run, archive = [], path.as_py().rpartition("/")[2]
            for place, (offset, length, data) in enumerate(members(content.as_buffer())):
                fields, payload = parse_record(data)
                response = fields["WARC-Type"] == "response"
                run.append({
                    "url_key": url_key(fields.get("WARC-Target-URI")), "captured": fields["WARC-Date"], "page_id": _id(fields.get("WARC-Record-ID")),
                    "payload_bytes": len(payload) if response else int(fields["X-Payload-Bytes"]),
                    "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"],
                    "refers_to": _id(fields.get("WARC-Refers-To")), "archive": archive, "place": place, "offset": offset, "length": length})
            run.sort(key=sort_key)
            blocks = [run[i : i + BLOCK] for i in range(0, len(run), BLOCK)]
            if blocks:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive] * len(blocks)), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.list_(_ENTRY_TYPE))],
                    names=["run", "block", "entries"])


RUN = f"run string, block int, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>"


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, block, entries): each archive's captures in key order, in blocks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(_runs, RUN)


class LoserTree:
    """Merges k sorted iterators. Inner nodes hold the loser of their match, so each entry
    costs one walk from its leaf to the root."""

    def __init__(self, sources: list[Iterator], key):
        self.sources, self.key = [iter(s) for s in sources], key
        self.k = len(sources)
        self.items = [next(s, None) for s in self.sources]
        self.keys = [None if x is None else key(x) for x in self.items]
        self.losers = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._play(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[b] is None or self.keys[a] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k:
            winner = self.losers[0]
            if self.keys[winner] is None:
                return
            yield self.items[winner]
            self.items[winner] = x = next(self.sources[winner], None)
            self.keys[winner] = None if x is None else self.key(x)
            self._play(winner)


def _cut(splitters: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"range": [], "run": [], "block": [], "entries": []}
            for name, block, entries in zip(*(batch.column(c).to_pylist() for c in ("run", "block", "entries"))):
                keys, at = [sort_key(e) for e in entries], 0
                while at < len(entries):
                    k = bisect_right(splitters, keys[at])
                    end = bisect_left(keys, splitters[k], lo=at) if k < len(splitters) else len(entries)
                    for c, v in zip(out, (k, name, block, entries[at:end])):
                        out[c].append(v)
                    at = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["range"], pa.int32()), pa.array(out["run"], pa.string()), pa.array(out["block"], pa.int32()),
                 pa.array(out["entries"], pa.list_(_ENTRY_TYPE))], names=list(out))

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, by_run = None, {}

    def merged() -> Iterator[pa.RecordBatch]:
        rows = list(LoserTree(list(by_run.values()), sort_key))
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_struct_array(pa.array(rows[i : i + 10_000], _ENTRY_TYPE))

    for batch in batches:
        for k, name, entries in zip(*(batch.column(c).to_pylist() for c in ("range", "run", "entries"))):
            if k != current:
                yield from merged()
                current, by_run = k, {}
            by_run.setdefault(name, []).extend(entries)
    yield from merged()


def merge_runs(stored: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per capture in global key order, from ``runs`` that were stored."""
    total = stored.agg(F.sum(F.size("entries")).alias("n")).first()["n"] or 0
    wanted = partitions(total, range_rows, 1)
    # every block gives keys at even distances, SAMPLED_KEYS over all blocks at most
    every = max(BLOCK // 4, -(-total // SAMPLED_KEYS))
    places = F.sequence(F.pmod(F.xxhash64("run", "block"), F.lit(every)).cast("int"), F.lit(BLOCK - 1 + every), F.lit(int(every)))
    drawn = F.transform(F.filter(places, lambda i: i < F.size("entries")), lambda i: F.get("entries", i))
    sampled = stored.select(F.explode(drawn).alias("e")).select(*[F.col(f"e.{c}").alias(c) for c in _KEY]).collect() if wanted > 1 else []
    keys = sorted(sort_key(r.asDict()) for r in sampled)
    splitters = sorted({keys[i * len(keys) // wanted] for i in range(1, wanted)}) if keys else []
    pieces = stored.mapInArrow(_cut(splitters), f"range int, {RUN}")
    dealt = pieces.repartitionByRange(len(splitters) + 1, "range").sortWithinPartitions("range", "run", "block")
    return dealt.mapInArrow(_merge, ENTRY)


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The globally ordered index of the archives in ``path``."""
    prepare(spark)
    return merge_runs(materialize(runs(spark, path), "warc-runs"))
