"""Packing of tokenized documents into windows: best-fit decreasing with a segment tree."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from roadloom.llm.cluster import stored

#: Words whose ids a worker holds: two generations of half as many each, some 120 MB; longer words aren't held.
CACHE_WORDS, CACHE_LETTERS = 600_000, 64
#: About so many pieces are packed together; a bucket wastes at most its last windows.
BUCKET_PIECES = 20_000

#: Letters, and marks behind them; the vocabulary's own rule parts the two, so that either is encoded once.
_SHAPE = re.compile(rb"((?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+)([.,!?;:|]+)?")
#: Byte-level vocabularies write a byte as the character of its number, but for those that don't print.
_BYTE_SIGN = {0xA0: chr(322), 0xAD: chr(323)}


#: What a tokenizer file must say for words to be encoded one by one: white space parts words, letters count in lower case.
_BY_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class WordIds(dict):
    """Word -> its ids as little-endian 32-bit numbers; words not used for a generation are forgotten."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        rules = json.loads(Path(path).read_text())
        self.by_words = (rules["normalizer"], rules["pre_tokenizer"]) == _BY_WORDS and rules["model"]["type"] == "BPE"
        self.older: dict[bytes, bytes] = {}

    def encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            shape = _SHAPE.fullmatch(word)
            if shape is None:
                found = self.encoded(word.decode())
            elif shape[2]:
                found = self[shape[1]] + self[shape[2]]
            else:  # letters alone pass all rules before the merges unchanged
                text = word.decode() if word.isascii() else word.decode("latin-1").translate(_BYTE_SIGN)
                found = array("I", [t.id for t in self.merges.tokenize(text)]).tobytes()
        if len(word) <= CACHE_LETTERS:
            if len(self) >= CACHE_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str | None, end: bytes) -> bytes:
        """Ids of a whole text and ``end``.

        By the rules of the known tokenizer these are the ids of the words between ASCII white space,
        and letters A-Z have the ids of a-z: but a letter before a combining mark of U+0300 to U+037F
        may compose in lower case only, so that a text with such a mark is encoded as it is written,
        as is one with the spelling of a special token. Any other tokenizer encodes whole texts.
        """
        if not self.by_words:
            return self.encoded(text or "") + end
        data = (text or "").encode()
        if b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data:
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split())) + end


class TightestWindow:
    """Open windows by remaining capacity: a segment tree of counts finds the least capacity that holds a piece."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, window: int, remaining: int) -> None:
        self.windows[remaining].append(window)
        at = remaining + self.size
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The open window of least remaining capacity >= ``length``, removed from the tree."""
        tree, at = self.tree, length + self.size
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not tree[at]:
                    at += 1
        remaining = at - self.size
        while at:
            tree[at] -= 1
            at >>= 1
        return self.windows[remaining].pop(), remaining


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each piece; pieces go by falling length, ties in the given order, each into the tightest open window."""
    windows, offsets = [0] * len(lengths), [0] * len(lengths)
    tree, count = TightestWindow(capacity), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found, count = (count, capacity), count + 1
        windows[i], offsets[i] = found[0], capacity - found[1]
        tree.add(found[0], found[1] - lengths[i])
    return windows, offsets


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, window: int, end_id: int) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): full windows of each document and its rest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            rows, columns = [], [[], [], [], []]
            for row, text in enumerate(batch.column(1)):
                ids = words.encode(text.as_py(), end)
                for start in range(0, len(ids), 4 * window):
                    piece = ids[start : start + 4 * window]
                    rows.append(row)
                    for column, value in zip(columns, (start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id`` (a null or empty text: ``end_id`` alone). Overlong documents
    are first cut into full windows, each a sequence of its own; the rests are packed by best-fit
    decreasing in buckets of about ``bucket_pieces`` pieces dealt by hash, so that no task grows with
    the input. Equal lengths go by id and start; rows repeated with one id are packed as documents
    of their own. Other columns are not read; an empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, id_col, text_col, tokenizer_path, window, end_id), "pieces")
    full = pieces.where(F.col("length") == window)
    rest = pieces.where(F.col("length") < window)
    buckets = max(1, round(rest.count() / bucket_pieces))
    # Odd sequence numbers for buckets, even ones for full windows.
    full = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("bigint"))
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets)))
    schema = rest.schema.add("sequence_id", LongType()).add("offset", LongType())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None

        def close():
            table = pa.Table.from_batches(held)
            windows, offsets = best_fit_decreasing(table.column("length").to_pylist(), window)
            numbers = (np.array(windows, np.int64) * buckets + bucket) * 2 + 1
            return table.append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offsets, pa.int64())).combine_chunks().to_batches()

        for batch in batches:
            at = batch.column("bucket").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1), len(at)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi == lo:
                    continue
                if held and at[lo] != bucket:
                    yield from close()
                    held.clear()
                bucket = int(at[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from close()

    packed = rest.repartition("bucket").sortWithinPartitions("bucket", F.desc("length"), "id", "start").mapInArrow(fill, schema).drop("bucket")
    return full.unionByName(packed).withColumnRenamed("id", id_col)
