"""WARC archives: writing with revisit records, and reading by boundary-chain verification."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.cluster import discard, scratch_path, stored

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 100
RECORDS_PER_FILE = 2048
#: What ends a header, and what stands between records.
BREAK = "\r\n\r\n"
_DATE = "2020-01-01T00:00:00Z"
_MAGIC = b"WARC/1."
#: Parts of a hot digest's rows that meet its one winner apart.
SALTS = 16
#: Digests of repeated payloads (40 bytes each) are broadcast up to this number, shuffled beyond.
BROADCAST_ROWS = 200_000


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is the least id of an equal payload, null where the row is itself that one or is too short."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("payload").cast("binary"), 256)))
    firsts = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last")
    firsts = stored(firsts.select("digest", "first"), "firsts")
    if firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(firsts), "digest", "left")
    else:
        salted = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    joined = joined.withColumn("digest", F.lower(F.hex("digest")))
    return joined.select("id", "url", "payload", "digest", F.when(F.col("id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record per row as text files of at most ``RECORDS_PER_FILE`` records below ``path``.

    A payload of at least ``REVISIT_BYTES`` bytes that another row of smaller id has as well becomes
    a revisit record without content, which refers to that row's record and carries the length and
    digest of the full payload; rows repeated with the same id are all responses. A null payload is
    empty, a null url is an empty target, line breaks in a url become blanks. Rows with a null id are
    written with an empty id. The records are laid out in columns and written by Spark's own writer,
    so that any file system of the cluster will do.
    """
    rows = with_revisits(pages, id_col, url_col, payload_col)
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]+", " ")
    record = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record(F.col("id"))),
        F.lit(f"WARC-Date: {_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("payload").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record(F.col("refers_to")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.octet_length("payload").cast("string"))),
    )
    value = F.concat(header, F.lit(BREAK), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    rows.select(value.alias("value")).write.option("lineSep", BREAK).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _header(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def _content_length(header: dict[str, str]) -> int | None:
    value = header.get("content-length", "")
    return int(value) if value.isascii() and value.isdigit() and len(value) < 16 else None


def _number(value: str | None) -> int | None:
    digits = (value or "").rpartition(":")[2].rstrip(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _scan_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what stands between two breaks, in file order; block is the start of the split that read it."""
    rows = spark.read.option("lineSep", BREAK).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


_CANDIDATE = "file string, block bigint, at bigint, successor bigint, body bigint, type string, id bigint, refers_to bigint, url string, payload_length bigint, payload_digest string, content_length bigint, content_digest string, bytes_read bigint"
_NAMES = [c.split()[0] for c in _CANDIDATE.split(", ")]


def candidates(rows: DataFrame) -> DataFrame:
    """Every place where a record might begin, and for each split the bytes it read (type null).

    ``at``, ``body`` and ``successor`` are relative to the first byte that the split read: the next
    split of the file begins where this one ends. content_digest is null where the content goes on
    beyond the split.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, offset = None, 0
        opened: list[list] = []  # candidates whose content isn't complete: [row, bytes left, digest]
        out: list[tuple] = []

        def finish():
            for row, *_ in opened:
                out.append((*key, *row, None, None))
            opened.clear()
            if key is not None:
                out.append((*key, *[None] * 11, offset))

        def send():
            columns = list(zip(*out, strict=True)) if out else [()] * len(_NAMES)
            out.clear()
            kinds = [pa.string() if t.split()[1] == "string" else pa.int64() for t in _CANDIDATE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)

        for batch in batches:
            for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != key:
                    finish()
                    key, offset = (file, block), 0
                still = []
                for entry in opened:
                    left = entry[1]
                    piece = value[:left]
                    entry[2].update(piece)
                    left -= len(piece)
                    if left > 0 and len(piece) == len(value):
                        gap = BREAK.encode()[:left]
                        entry[2].update(gap)
                        left -= len(gap)
                    if left > 0:
                        entry[1] = left
                        still.append(entry)
                    else:
                        out.append((*key, *entry[0], entry[2].hexdigest(), None))
                opened = still
                lead = 2 if value[:2] == b"\r\n" else 0  # content that ends in an odd number of line breaks
                if value.startswith(_MAGIC, lead):
                    header = _header(value[lead:])
                    length = _content_length(header)
                    if length is not None:
                        body = offset + len(value) + 4
                        row = (
                            offset + lead, body + length + 4, body, header.get("warc-type"), _number(header.get("warc-record-id")), _number(header.get("warc-refers-to")), header.get("warc-target-uri"),
                            _number(header.get("x-payload-length")), header.get("warc-payload-digest", "").rpartition(":")[2] or None, length,
                        )
                        if length:
                            opened.append([row, length, hashlib.sha256()])
                        else:
                            out.append((*key, *row, hashlib.sha256().hexdigest(), None))
                offset += len(value) + 4
            if len(out) > 5000:
                yield send()
        finish()
        yield send()

    return rows.mapInArrow(scan, _CANDIDATE)


def reachable(nodes: DataFrame) -> DataFrame:
    """(file, at) of the candidates on the chain from each file's start, by pointer jumping.

    In round k every reached candidate reaches the one 2^k records on, and all pointers double; the
    rounds are as many as the logarithm of the longest chain.
    """
    jumps = stored(nodes.select("file", "at", "successor").join(nodes.select("file", F.col("at").alias("successor")), ["file", "successor"], "left_semi").select("file", "at", "successor"), "jumps")
    reached = stored(nodes.where("at = 0").select("file", "at"), "reached")
    while jumps.limit(1).count():
        further = reached.join(jumps, ["file", "at"]).select("file", F.col("successor").alias("at"))
        old, reached = reached, stored(reached.unionAll(further), "reached")
        discard(old)
        ahead = jumps.select("file", F.col("at").alias("successor"), F.col("successor").alias("beyond"))
        old, jumps = jumps, stored(jumps.join(ahead, ["file", "successor"]).select("file", "at", F.col("beyond").alias("successor")), "jumps")
        discard(old)
    return reached


def straddling(spark: SparkSession, path: str, records: DataFrame, splits: DataFrame) -> DataFrame:
    """(file, at, content_digest) of records whose content goes on beyond their split: at most one for each split, whose pieces are read again and put together."""
    held = records.where("content_digest is null").select("file", "at", "body", "content_length")
    cut = splits.join(held, "file").where("start < body + content_length and end > body")
    plan: dict[tuple, list] = defaultdict(list)
    for r in cut.select("file", "block", "start", "at", "body", "content_length").toLocalIterator():  # as many rows as splits that the content touches
        plan[r["file"], r["block"]].append((r["at"], r["body"] - r["start"], r["body"] - r["start"] + r["content_length"]))
    if not plan:
        return records.limit(0).select("file", "at", F.lit("").alias("content_digest"))
    shared = spark.sparkContext.broadcast(dict(plan))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, offset = None, 0
        for batch in batches:
            out = []
            for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != key:
                    key, offset = (file, block), 0
                data = value + BREAK.encode()
                for at, lo, hi in shared.value.get(key, ()):
                    a, b = max(lo, offset), min(hi, offset + len(data))
                    if a < b:
                        out.append((file, at, a - lo, data[a - offset : b - offset]))
                offset += len(data)
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "at", "place", "piece"])

    found = _scan_rows(spark, path).mapInArrow(pieces, "file string, at bigint, place bigint, piece binary")
    whole = found.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("parts"))
    empty = F.lit("").cast("binary")
    return whole.select("file", "at", F.sha2(F.aggregate("parts", empty, lambda x, p: F.concat(x, p["piece"])), 256).alias("content_digest"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``: file, at, type, id, refers_to, url, payload_length, payload_digest, content_length, content_digest.

    Each task scans a split for records that might begin there and computes where the next would;
    only what is reached from the start of its file is a record, so that a payload may hold whole
    records of its own. payload_length and payload_digest are those of the header, content_digest the
    SHA-256 of the bytes read. Headers without a proper Content-Length begin no record.
    """
    found = stored(candidates(_scan_rows(spark, path)), "candidates")
    before = "coalesce(sum(bytes_read) over (partition by file order by block rows between unbounded preceding and 1 preceding), 0L)"
    splits = found.where("bytes_read is not null").selectExpr("file", "block", f"{before} as start", "bytes_read").withColumn("end", F.col("start") + F.col("bytes_read"))
    splits = stored(splits, "splits")
    placed = found.where("bytes_read is null").join(splits.select("file", "block", "start"), ["file", "block"])
    placed = placed.select(*(F.expr(f"{c} + start").alias(c) if c in ("at", "successor", "body") else F.col(c) for c in _NAMES if c not in ("block", "bytes_read")))
    placed = stored(placed, "placed")
    records = stored(placed.join(reachable(placed), ["file", "at"], "left_semi"), "records")
    mended = straddling(spark, path, records, splits).withColumnRenamed("content_digest", "mended")
    out = records.join(mended, ["file", "at"], "left")
    return out.withColumn("content_digest", F.coalesce("content_digest", "mended")).drop("mended", "body", "successor")


def warc_round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, content_digest.

    payload_bytes and payload_digest are those of the full payload: of a response as read, of a
    revisit as its header says. An empty table writes no records and gives no rows.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, payload_col)
    records = read_warc(spark, path)
    revisit = F.col("type") == "revisit"
    return records.select(
        F.col("id").alias(id_col),
        F.when(revisit, F.col("payload_length")).otherwise(F.col("content_length")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.col("content_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
        "content_digest",
    )
