"""Language-model scoring: a hashed maximum-entropy model, its softmax factored into a tree of nested classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm import textscan as ts
from roadloom.llm.cluster import stored

SLICES = 64
#: Slots of weights are the next power of two from the training tokens divided by this, within these bounds:
#: the least so that small corpora have few collisions, the most (256 MB) what every executor can hold.
TOKENS_PER_SLOT = 32
LEAST_BITS, MOST_BITS = 20, 26
#: Decisions of a path that all features have a say in; in those below only the word before has.
SHALLOW = 4
#: Tokens whose decisions are computed at once.
STEP = 1 << 11
#: Words whose counts are broadcast (8 + 8 bytes each); the others' meet their counts in a shuffle.
TOP_WORDS = 1 << 17
END = np.uint64(0x656E642D6F662D74)
#: A weight's step is its gradient by the update's rate x its decisions + the update's damping.
STEPS = ((0.25, 6), (0.3, 10))
#: Distinct words that a task holds before it sends partial counts.
HELD_WORDS = 400_000


def token_chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(hashes, documents, number of documents) of bounded chunks: words between ASCII white space, lower-cased in A-Z, and one end for each document."""
    data, offsets = ts.text_buffers(column)
    for _, _, chunk, bounds in ts.chunks(data, offsets):
        folded = ts.FOLD[chunk]
        n = len(bounds) - 1
        starts, ends, docs = ts.spans(folded, bounds, ts.TOKEN)
        words = ts.Hasher(folded).ranges(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        at = np.searchsorted(docs, np.arange(n), side="right")
        yield np.insert(words, at, END), np.insert(docs, at, np.arange(n)), n


def word_counts(column: DataFrame) -> DataFrame:
    """(word, n) of a table of one text column; tasks add up what they read before they send it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
            return words, np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

        def send(words, counts):
            for i in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], ["word", "n"])

        for batch in batches:
            for words, _, _ in token_chunks(batch.column(0)):
                parts.append(np.unique(words, return_counts=True))
                size += len(parts[-1][0])
                if size > HELD_WORDS:
                    held = merged()
                    if len(held[0]) > HELD_WORDS // 2:
                        yield from send(*held)
                        parts, size = [], 0
                    else:
                        parts, size = [held], len(held[0])
        if parts:
            yield from send(*merged())

    return column.mapInArrow(scan, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def contexts(tokens: np.ndarray, docs: np.ndarray, used: int = 3) -> list[np.ndarray]:
    """The first ``used`` hashed features of each token: the word before; the two before as a pair; the second before, skipping the one between."""

    def before(k: int) -> np.ndarray:
        word = np.full(len(tokens), 0x5F, np.uint64)
        word[k:] = np.where(docs[k:] == docs[:-k], tokens[:-k], np.uint64(0x5F))
        return word

    one = before(1)
    values = [one]
    if used > 1:
        two = before(2)
        values += [one * np.uint64(0x100000001B3) + two, two]
    return [halves(ts.mix(x + np.uint64(salt * 0x9E3779B1))) for salt, x in enumerate(values[:used], 1)]


def halves(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def slots_for(tokens: int) -> int:
    """Bits of the number of weights."""
    return min(MOST_BITS, max(LEAST_BITS, (tokens // TOKENS_PER_SLOT).bit_length()))


@dataclass
class Model:
    """Each word is a leaf of a binary tree; every branch on the way to it is a logistic decision on the context.

    Broadcast words have Shannon-Fano-Elias codes by count, ``offsets`` into the decisions of each
    (the last: of all others together); below that the others part by ``hash_bits`` bits of their hash.
    """

    words: np.ndarray  # sorted hashes of the most frequent words
    counts: np.ndarray
    offsets: np.ndarray
    nodes: np.ndarray
    signs: np.ndarray  # -1 where the way goes to the upper half, else 1
    priors: np.ndarray  # log odds of the counts below a node
    hash_bits: int
    weights: np.ndarray

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Places of tokens among the broadcast words; their number for all others."""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, at, len(self.words))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        # Features and nodes are both mixed, so that the first bits of their sum are as good as a hash of the pair.
        hashes >>= np.uint32(33 - len(self.weights).bit_length())
        return hashes.astype(np.intp)

    def decisions(self, tokens: np.ndarray, place: np.ndarray, features: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(token, sign, log odds, slots of each feature) of the decisions of the tokens: first ones, deeper ones, and those among the other words."""
        first, all_of = self.offsets[place], self.offsets[place + 1] - self.offsets[place]
        top = np.minimum(all_of, SHALLOW)
        parts = ((first, top, features), (first + top, all_of - top, features[:1])) if len(features) > 1 else ((first, all_of, features),)
        for start, n, used in parts:
            token = np.repeat(np.arange(len(tokens), dtype=np.int32), n)
            at = np.repeat(start - (np.cumsum(n) - n), n)
            at += np.arange(len(at))
            node = self.nodes.take(at)
            yield self.weighed(token, self.signs.take(at), self.priors.take(at), [np.repeat(f, n) + node for f in used])
        others = np.flatnonzero(place == len(self.words)) if self.hash_bits else ()
        if len(others):
            level = np.tile(np.arange(self.hash_bits, dtype=np.uint64), len(others))
            leaf = np.repeat(tokens[others] >> np.uint64(64 - self.hash_bits), self.hash_bits)
            node = halves(ts.mix((np.uint64(1) << level) + (leaf >> (np.uint64(self.hash_bits) - level)) + np.uint64(1 << 62)))
            upper = ((leaf >> (np.uint64(self.hash_bits - 1) - level)) & np.uint64(1)).astype(np.float32)
            # Without counts of what is below them, these learn their odds.
            hashes = [np.repeat(features[0][others], self.hash_bits) + node, node]
            yield self.weighed(np.repeat(others, self.hash_bits), 1 - 2 * upper, np.zeros(len(node), np.float32), hashes)

    def weighed(self, token, sign, logits, hashes):
        slots = [self.slots(h) for h in hashes]
        for s in slots:
            logits += self.weights.take(s)
        return token, sign, logits, slots

    def steps(self, tokens: np.ndarray, docs: np.ndarray, place: np.ndarray, used: int = 3) -> Iterator[tuple]:
        """(first token, end token, decisions) of runs of tokens, on all features or the first ``used``."""
        features = contexts(tokens, docs, used)
        for s in range(0, len(tokens), STEP):
            e = min(s + STEP, len(tokens))
            yield s, e, self.decisions(tokens[s:e], place[s:e], [f[s:e] for f in features])

    def scores(self, tokens: np.ndarray, docs: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of each token's leaf."""
        out = np.zeros(len(tokens))
        for s, e, parts in self.steps(tokens, docs, place):
            for token, sign, logits, _ in parts:
                x = sign * logits  # minus the log probability is log(1 + exp(x))
                out[s:e] += np.bincount(token, weights=np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x))), minlength=e - s)
        return out / -np.log(10)


def tree(counts: np.ndarray, others: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, nodes, bits, priors): the decisions of each word of ``counts`` and of all others, which weigh ``others``.

    A code is the start of the middle of the word's share of [0, 1), heaviest words first; a node with all weight on one side asks nothing.
    """
    mass = np.r_[counts + 1, others]
    order = np.argsort(-mass, kind="stable")
    share = mass[order] / mass.sum()
    sums = np.r_[0, np.cumsum(share)]
    middle = sums[:-1] + share / 2
    length = np.ceil(-np.log2(share)).astype(np.int64) + 1
    code = np.floor(middle * 2.0**length).astype(np.int64)
    words, depths, nodes, bits, priors = [], [], [], [], []
    for d in range(int(length.max())):
        w = np.flatnonzero(length > d)
        prefix = code[w] >> (length[w] - d)
        low, half, high = (np.searchsorted(middle, (prefix + x) / 2.0**d) for x in (0, 0.5, 1))
        both = (low < half) & (half < high)
        w, prefix, low, half, high = (x[both] for x in (w, prefix, low, half, high))
        words.append(order[w])
        depths.append(np.full(len(w), d))
        nodes.append(prefix.astype(np.uint64) + np.uint64(1 << d))
        bits.append(code[w] >> (length[w] - d - 1) & 1)
        priors.append(np.log((sums[high] - sums[half]) / (sums[half] - sums[low])))
    words, depths, nodes, bits, priors = (np.concatenate(x) for x in (words, depths, nodes, bits, priors))
    sort = np.lexsort((depths, words))
    offsets = np.r_[0, np.cumsum(np.bincount(words, minlength=len(mass)))]
    return offsets, halves(ts.mix(nodes[sort])), (1 - 2 * bits[sort]).astype(np.float32), priors[sort].astype(np.float32)


UPDATES = ("word before", "others")


def taught(model: Model, tokens: np.ndarray, docs: np.ndarray, update: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(sign, log odds, slots) of what an update teaches: first the word before in all decisions, then, on top of it, the other features in those decisions that have them."""
    if update == UPDATES[0]:
        for _, _, parts in model.steps(tokens, docs, model.find(tokens), 1):
            for _, sign, logits, slots in parts:
                yield sign, logits, slots
    else:
        for _, _, parts in model.steps(tokens, docs, model.find(tokens)):
            _, sign, logits, slots = next(parts)
            yield sign, logits, slots[1:]


def gradient(docs: DataFrame, model, update: str) -> DataFrame:
    """(slice, sums) of a table of one text column: summed gradients and after them the decisions, in float32 for each slice of the slots; tasks send theirs rounded to 8 significant bits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        sums = np.zeros((2, len(m.weights)))
        for batch in batches:
            for tokens, at, _ in token_chunks(batch.column(0)):
                for sign, logits, slots in taught(m, tokens, at, update):
                    error = sign / (1 + np.exp(-sign * logits)).astype(np.float64)
                    for x in slots:
                        np.add.at(sums[0], x, error)
                        np.add.at(sums[1], x, 1.0)
        for i, part in enumerate(np.split(sums, SLICES, axis=1)):
            if part.any():
                part = (part.astype(np.float32).view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)  # the first 16 bits: 8 of exponent, 7 of fraction
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.astype(np.uint16).tobytes()], pa.binary())], ["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = (np.frombuffer(part, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)
                total[at] = total[at] + part if at in total else part.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["slice", "sums"])

    # One set of sums for each core, however many files there are.
    docs = docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    return docs.mapInArrow(scan, "slice int, sums binary").repartition("slice").mapInArrow(add, "slice int, sums binary")


def fit(train: DataFrame, counts: DataFrame) -> tuple[Model, int, int, int]:
    """The model, and tokens and distinct tokens of ``train`` (one text column), and the least count of a broadcast word.

    Each of the updates reads every training row. Leaves grow with the vocabulary, slots with
    the tokens.
    """
    spark = train.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # The least count so that at most TOP_WORDS words have it: from the table of counts of counts, which is short.
    least, so_far = 1, 0
    for row in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if so_far + row["words"] > TOP_WORDS:
            least = row["n"] + 1
            break
        so_far += row["words"]
    top = counts.where(F.col("n") >= least).orderBy("word").toArrow() if total["n"] else pa.table({"word": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    words, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy().astype(np.float64)
    order = np.argsort(words)
    words, n = words[order], n[order]
    others = int(total["v"]) - len(words)
    bits = slots_for(int(total["n"]))
    model = Model(words, n, *tree(n, int(total["n"]) - n.sum() + others + 1), others.bit_length() if others else 0, np.zeros(1 << bits, np.float32))
    k = (1 << bits) // SLICES
    for update, (rate, damping) in zip(UPDATES, STEPS, strict=True) if total["n"] else ():
        held = spark.sparkContext.broadcast(model)
        for row in gradient(train, held, update).toLocalIterator():  # a slice at a time, for the driver's memory
            at = slice(row["slice"] * k, (row["slice"] + 1) * k)
            error, seen = np.frombuffer(row["sums"], np.float32).reshape(2, k)
            # Each weight's step is its summed gradient, scaled by the number of its decisions.
            model.weights[at] -= np.clip(error / (rate * seen + damping), -2, 2)
        held.destroy()
    return model, int(total["n"]), int(total["v"]), least


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from the rows with crc32(id as text) mod 7 other than 2 (a null id counts as held out).
    base_score is the add-one unigram log10 probability; score that of the model, the product of the
    decisions of a tree with about a leaf for each word, each on the features of the words before.
    Words that share a leaf (by hash, outside the broadcast ones) share it by add-one counts. A null or empty text is its end alone. Words are told apart by 64-bit hashes.
    Rows repeated are scored each. Without training rows every word is unknown. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(True))
    train = docs.where(~held_out).select(F.col(text_col).alias("text"))
    counts = stored(word_counts(train), "counts")
    model, n_train, vocabulary, least = fit(train, counts)
    held = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        known_log = np.r_[np.log10(m.counts + 1), 0]
        for batch in batches:
            out, rare = [], []
            for tokens, at, n in token_chunks(batch.column(0)):
                place = m.find(tokens)
                score = m.scores(tokens, at, place)
                known = place < len(m.words)
                log = known_log[place]
                edges = np.searchsorted(at, np.arange(n))
                sums = [np.add.reduceat(x, edges) for x in (np.ones(len(tokens)), known.astype(float), log, score)]
                out.append(np.stack(sums))
                unknown = np.flatnonzero(~known)
                cuts = np.searchsorted(at[unknown], np.arange(n + 1))
                missing = tokens[unknown].view(np.int64)
                rare += [missing[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            sums = np.concatenate(out, axis=1) if out else np.zeros((4, 0))
            columns = [pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]), pa.array(rare, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "n_tokens", "known", "log", "model", "rare"])

    rows = docs.select(F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held_out.alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    summary = stored(rows.mapInArrow(scan, f"row bigint, id {kind}, held_out boolean, n_tokens bigint, known bigint, log double, model double, rare array<bigint>"), "summary")
    # What is not broadcast has a low count and few words to a leaf, so that no key of this join is hot; what no count is found for was never seen.
    leaf = F.shiftrightunsigned("word", 64 - model.hash_bits) if model.hash_bits else F.lit(0).cast("bigint")
    leaves = counts.where(F.col("n") < least).groupBy(leaf.alias("leaf")).agg((F.sum("n") + F.count(F.lit(1)) + 1).alias("all"), F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("held"))
    rare = summary.select("row", F.explode("rare").alias("word")).withColumn("leaf", leaf).join(leaves, "leaf").select("row", "all", F.col("held")[F.col("word")].alias("n"))
    log = F.log10(F.coalesce("n", F.lit(0)) + 1)
    rare = rare.groupBy("row").agg(F.sum(log).alias("rare_log"), F.sum(log - F.log10("all")).alias("rare_share"), F.count("n").alias("rare_known"))
    joined = summary.drop("rare").join(rare, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("log") + rare_log - F.col("n_tokens") * F.log10(F.lit(float(n_train + vocabulary + 1)))).alias("base_score"),
        (F.col("model") + F.coalesce("rare_share", F.lit(0.0))).alias("score"),
    )
