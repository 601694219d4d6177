"""Benchmark decontamination: pieces of test items by pigeonhole, verified with Myers' bit-parallel distance."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of test items that one pass over the documents holds.
BLOCK_CHARS = 8_000_000
CHUNK = 1 << 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalise(text: str | None) -> str:
    """Words of ASCII letters, digits and characters beyond ASCII, lower-cased in A-Z, with single spaces."""
    return b" ".join((text or "").encode().translate(_TABLE).split()).decode()


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """(start, piece): ``budget`` + 1 pieces that cover the item; with at most ``budget`` edits one is left whole."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(pattern_bits: dict[str, int], length: int, text: str, start: int, end: int) -> tuple[int, int]:
    """(distance, end) of the best match of the pattern anywhere in text[start:end], the first of equals; one machine word is a Python integer."""
    full, last = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best = full, 0, length, (length, start)
    get = pattern_bits.get
    for at in range(start, end):
        eq = get(text[at], 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & last:
            score += 1
        elif down & last:
            score -= 1
            if score < best[0]:
                best = score, at + 1
        up = (up << 1) & full
        down = (down << 1) & full
        eq |= minus
        plus = down | (full & ~(eq | up))
        minus = up & eq
    return best


def bits_of(item: str) -> dict[str, int]:
    bits: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        bits[c] |= 1 << i
    return dict(bits)


class Matcher:
    """Finds a block of test items in many texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.budgets, self.bits = items, [math.floor(rate * len(t)) for _, t in items], {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, text) in enumerate(items):
            for start, piece in pieces_of(text, self.budgets[i]):
                places[piece].append((i, start))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, end) of the best match of each item in each text, if within its budget."""
        if self.empty:
            return []
        bounds, size = [0], 0
        for t in texts:
            size += len(t) + 1
            bounds.append(size)
        joined = "\0".join(texts)
        hits: dict[tuple[int, int], set[int]] = defaultdict(set)
        for last, (length, places) in self.automaton.iter(joined):
            first = last - length + 1
            doc = bisect_right(bounds, first) - 1
            for item, start in places:
                hits[doc, item].add(first - start)
        out = []
        for (doc, item), starts in hits.items():
            text, budget = self.items[item][1], self.budgets[item]
            lo, hi = bounds[doc], bounds[doc + 1] - 1
            exact = [s for s in sorted(starts) if s >= lo and joined.startswith(text, s)]
            if exact:
                out.append((doc, item, 0, exact[0] + len(text) - lo))
                continue
            if budget == 0:
                continue
            windows: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(lo, s - budget), min(hi, s + len(text) + budget)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], b)
                else:
                    windows.append([a, b])
            if item not in self.bits:
                self.bits[item] = bits_of(text)
            found = min((myers(self.bits[item], len(text), joined, a, b) for a, b in windows if b - a >= len(text) - budget), default=(budget + 1, 0))
            if found[0] <= budget:
                out.append((doc, item, found[0], found[1] - lo))
        return out


@lru_cache(maxsize=1)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(list(items), rate)


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """The test items in blocks of about ``block_chars`` characters, each of which fits the driver."""
    rows = items.select(F.col(item_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / block_chars))
    for block in range(count):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == block).distinct().orderBy("id", "text").collect()
        found = tuple((r["id"], t) for r in part if (t := normalise(r["text"])))
        if found:
            yield found


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.08, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item_id, distance, item_chars, start, end): every document with a passage within the error budget of a test item.

    Texts are compared as words in lower case with single spaces; an item's budget is ``rate`` of its
    characters, rounded down. The item is cut into budget + 1 pieces; wherever a piece stands in a
    document, Myers' algorithm finds the best match around it. One row for each pair, with the least
    distance and the end of its first place, in characters of the compared text; ``start`` is the end less the item's length, at least 0.
    Items without words match nothing; a null or empty document matches nothing; repeated documents
    give repeated rows, repeated items one. Items with a null id are not searched for. The items are
    taken in blocks of bounded size, each with a pass over the documents; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item_id bigint, distance int, item_chars int, start bigint, end bigint"
    out = None
    for block in item_blocks(items, item_col, item_text, block_chars):
        held = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(held.value, rate)
            for batch in batches:
                found, texts, size, first = [], [], 0, 0
                column = batch.column(1)
                for row in range(batch.num_rows + 1):
                    if texts and (row == batch.num_rows or size > CHUNK):
                        found += [(first + d, *rest) for d, *rest in matcher.search(texts)]
                        first, texts, size = row, [], 0
                    if row < batch.num_rows:
                        texts.append(normalise(column[row].as_py()))
                        size += len(texts[-1])
                ids = [block_id for block_id, _ in matcher.items]
                lengths = [len(matcher.items[i][1]) for _, i, _, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                        pa.array([ids[f[1]] for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.int32()),
                        pa.array(lengths, pa.int32()),
                        pa.array([max(0, f[3] - n) for f, n in zip(found, lengths, strict=True)], pa.int64()),
                        pa.array([f[3] for f in found], pa.int64()),
                    ],
                    ["id", "item_id", "distance", "item_chars", "start", "end"],
                )

        part = rows.mapInArrow(scan, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = rows.limit(0).selectExpr("id", "0L as item_id", "0 as distance", "0 as item_chars", "0L as `start`", "0L as `end`")
    return out.withColumnRenamed("id", id_col)
