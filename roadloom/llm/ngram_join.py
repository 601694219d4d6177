"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm import textscan as ts
from roadloom.llm.cluster import stored, within
from roadloom.llm.components import connected_components

#: A block of a candidate component has at most about so many documents and n-grams.
BLOCK_DOCS = 256
BLOCK_GRAMS = 400_000


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of ``rows`` hashes with which a pair at ``threshold`` meets with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def word_chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(words' hashes, words' documents, number of documents) of bounded chunks of a text column."""
    data, offsets = ts.text_buffers(column)
    for _, _, chunk, bounds in ts.chunks(data, offsets):
        folded = ts.FOLD[chunk]
        starts, ends, docs = ts.spans(folded, bounds, ts.WORD)
        yield ts.Hasher(folded).ranges(starts, ends) if len(starts) else np.zeros(0, np.uint64), docs, len(bounds) - 1


def node_of(words: np.ndarray) -> int:
    """A 64-bit number of a word sequence."""
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, node, bands) of (id, text): the word sequence's number and one hash for each band; a text without words has no bands."""
    # Minima of one hash under different masks depend on each other in small sets; a factor and a mixing step each make other orders.
    factors = np.random.default_rng(20240301).integers(0, 1 << 63, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, hashes = [], []
            for words, at, count in word_chunks(batch.column(1)):
                edges = np.searchsorted(at, np.arange(count + 1))
                nodes += [node_of(words[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
                grams, gram_docs = ts.word_grams(words, at, n)
                out = [None] * count
                if len(grams):
                    there, first = np.unique(gram_docs, return_index=True)
                    keys = np.zeros((bands, len(there)), np.uint64)
                    hashed, high = np.empty_like(grams), np.empty_like(grams)
                    for i, factor in enumerate(factors):
                        np.multiply(grams, factor, out=hashed)
                        np.right_shift(hashed, np.uint64(32), out=high)
                        hashed ^= high
                        hashed *= np.uint64(0xD6E8FEB86659FD93)
                        key = keys[i // rows]
                        key *= np.uint64(0x100000001B3)
                        key += np.minimum.reduceat(hashed, first)
                    keys ^= np.arange(bands, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
                    for d, key in zip(there, ts.mix(keys).view(np.int64).T, strict=True):
                        out[d] = key
                hashes += out
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["id", "node", "bands"])

    return docs.mapInArrow(scan, f"id {docs.schema['id'].dataType.simpleString()}, node bigint, bands array<bigint>")


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, copies, part, grams) of (id, text, node, copies, part): the sorted set of n-gram hashes of the rows whose text is that of the node."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for words, at, count in word_chunks(batch.column(1)):
                grams, gram_docs = ts.word_grams(words, at, n)
                edges = np.searchsorted(at, np.arange(count + 1))
                nodes += [node_of(words[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
                edges = np.searchsorted(gram_docs, np.arange(count + 1))
                sets += [np.unique(grams[s:e]).view(np.int64) for s, e in zip(edges[:-1], edges[1:], strict=True)]
            kept = [i for i, (node, wanted) in enumerate(zip(nodes, batch.column(2).to_pylist(), strict=True)) if node == wanted]
            columns = [batch.column(k).take(pa.array(kept, pa.int64())) for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sets[i] for i in kept], pa.list_(pa.int64()))], ["node", "copies", "part", "grams"])

    return docs.mapInArrow(scan, "node bigint, copies bigint, part bigint, grams array<bigint>")


def verify(blocks: DataFrame, threshold: float) -> DataFrame:
    """Links inside blocks of (part, id, copies, left, right, grams): (kind, a, b, n).

    Rows come sorted by part. ``left`` and ``right`` say on which side of the block pair a document
    stands (both, in a block against itself). Kind 0 are edges (a, b) of a forest that joins what is
    linked; kind 1 are counts ``n`` of the rows linked to a. Pairs themselves never leave the task.
    """

    def links(ids: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        new = np.r_[True, grams[1:] != grams[:-1]]
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1
        column, owner = column[shared], owner[shared]
        common = np.zeros((len(sets), len(sets)), np.float32)
        if len(column):
            column = np.unique(column, return_inverse=True)[1]
            step = max(64, 4_000_000 // len(sets))
            for first in range(0, int(column[-1]) + 1, step):
                lo, hi = np.searchsorted(column, (first, first + step))
                dense = np.zeros((len(sets), min(step, int(column[-1]) + 1 - first)), np.float32)
                dense[owner[lo:hi], column[lo:hi] - first] = 1
                common += dense @ dense.T
        linked = common >= threshold * (sizes[:, None] + sizes[None] - common) - 1e-6
        np.fill_diagonal(linked, False)
        cross = left[:, None] & right[None]
        cross |= cross.T
        linked &= cross
        count = linked @ copies
        edges = []
        todo = np.ones(len(ids), bool)
        for start in range(len(ids)):  # breadth first, so that a dense group costs a row for each member
            if not todo[start]:
                continue
            todo[start] = False
            front = [start]
            while front:
                x = front.pop()
                for y in np.flatnonzero(linked[x] & todo):
                    todo[y] = False
                    edges.append((ids[x], ids[y]))
                    front.append(y)
        return edges, [(i, c) for i, c in zip(ids, count, strict=True) if c]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []

        def flush():
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["kind", "a", "b", "n"])

        held: list[tuple] = []
        part = None

        def close():
            if len(held) > 1:
                ids, copies, left, right, sets = zip(*held, strict=True)
                edges, counts = links(np.array(ids), np.array(copies, np.float64), np.array(left), np.array(right), list(sets))
                out.extend((0, int(a), int(b), 0) for a, b in edges)
                out.extend((1, int(a), 0, int(c)) for a, c in counts)
            held.clear()

        for batch in batches:
            grams = batch.column(5)
            values, bounds = grams.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(np.diff(grams.offsets.to_numpy()))]
            for row, (p, i, c, x, y) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
                if p != part:
                    close()
                    part = p
                elif held and held[-1][0] == i:  # the same row twice
                    continue
                held.append((i, c, x, y, values[bounds[row] : bounds[row + 1]].copy()))
            if len(out) > 50_000:
                yield flush()
        close()
        yield flush()

    return blocks.mapInArrow(scan, "kind bigint, a bigint, b bigint, n bigint")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, rows: int = 6) -> DataFrame:
    """(id, class_id, n_links) for every row of ``docs``.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, lower-cased in A-Z; a
    text shorter than ``n`` words is one n-gram. Two texts are linked when the Jaccard similarity of
    their sets of word n-grams is at least ``threshold``. class_id is the smallest id of the texts
    linked directly or through others; n_links counts the other rows linked directly. Texts of the
    same words are always linked; so are texts without words (null, empty, marks only). Rows with the
    same id and words are further copies. Ids are of any type that can be ordered. Rows with a null id are returned with a null class and 0
    links. Other columns of ``docs`` are not read; an empty table gives no rows.

    Copies of one word sequence are one text from the first step on. Texts that share a band of
    ``rows`` MinHash values are candidates (``recall`` is the share of pairs at the threshold that
    meet; pairs above it meet more often). Components of candidates are verified in blocks of bounded
    size, each against each other, where a sparse product counts common n-grams; only a spanning
    forest and sums leave a task, so that no hot group is ever listed pair by pair.
    """
    bands = bands_for(threshold, recall, rows)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType
    marked = stored(signatures(source.where("id is not null"), n, bands, rows), "signatures")
    texts = stored(marked.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "texts")

    once = marked.join(texts.select("node", "id"), ["node", "id"], "left_semi").select("node", F.explode("bands").alias("key"))
    keys = stored(once, "bands")
    buckets = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first != last").select("key", "first")
    parts = connected_components(keys.join(buckets, "key").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")))

    members = parts.select("node", F.col("root").alias("part")).join(texts, "node")
    # Few texts are candidates: their short rows go to the texts, which stay where they are.
    wanted = source.join(within(stored(members, "members")), "id").select("id", "text", "node", "copies", "part")
    sets = stored(gram_sets(wanted, n), "grams")

    # A part is dealt to blocks by volume; every two blocks meet once, and so do the two sides of any link.
    volume = sets.groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("grams")).alias("grams"))
    count = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("grams") / BLOCK_GRAMS)).cast("int")
    volume = volume.where("docs > 1").select("part", count.alias("blocks"))
    dealt = sets.join(volume, "part").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select(
        F.xxhash64("part", low, high).alias("pair"), "node", "copies", (F.col("block") == low).alias("left"), (F.col("block") == high).alias("right"), "grams"
    )
    blocks = dealt.repartition("pair").sortWithinPartitions("pair", "node")
    found = stored(verify(blocks, threshold), "links")

    classes = connected_components(found.where("kind = 0").select("a", "b"))
    links = found.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    named = texts.join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where("links > 0").groupBy("root").agg(F.min("id").alias("class_id"))
    info = named.where("links > 0 or copies > 1").join(least, "root", "left")
    info = info.select("node", F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = marked.select("id", "node").join(info, "node", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    nulls = source.where("id is null").select("id", F.lit(None).cast(kind).alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return out.unionAll(nulls).withColumnRenamed("id", id_col)
