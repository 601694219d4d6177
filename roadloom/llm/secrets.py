"""Secret scan: patterns plus a character convolutional network over candidate strings in context."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "network")

#: Runs that the network judges: at least ``LEAST`` characters of key alphabets, of which ``DISTINCT`` differ (a random
#: key of 16 hexadecimal digits has fewer with a chance of 1 in 2,400,000; a rule of dashes has one).
LEAST, DISTINCT = 16, 5
#: Views that a task holds before it scores them.
HELD_WINDOWS = 20_000
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

BEFORE, BODY, AFTER = 24, 48, 8
STRIDE = 8
#: Parts of a long candidate that may be keys of their own.
PIECE = re.compile(r"[A-Za-z0-9]{16,}")
WIDTH = BEFORE + BODY + AFTER
CLASSES = 48
FILTERS, SPAN = 24, 5
#: Least share of labelled secrets that the threshold must keep.
RECALL = 0.98


def _symbols() -> np.ndarray:
    table = np.full(256, 1, np.int64)
    table[ord("a") : ord("z") + 1] = 2 + np.arange(26) // 2
    table[ord("A") : ord("Z") + 1] = 15 + np.arange(26) // 2
    table[ord("0") : ord("9") + 1] = 28 + np.arange(10)
    for i, mark in enumerate("=:\"' _-/.+"):
        table[ord(mark)] = 38 + i
    table[0] = 0
    return table


SYMBOL = _symbols()


def window(text: str, start: int, end: int) -> bytes:
    """The first ``BODY`` characters of the candidate with its surroundings in ``WIDTH`` bytes, padded with zeros."""
    end = min(end, start + BODY)
    parts = (text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), text[start:end].ljust(BODY, "\0"), text[end : end + AFTER].ljust(AFTER, "\0"))
    return "".join(parts).encode("latin-1", "replace")


def windows_of(text: str, start: int, end: int) -> list[bytes]:
    """Views of a candidate: a long one shows every ``BODY`` characters from steps of ``STRIDE``, the last ones, and each piece between marks."""
    if end - start <= BODY:
        return [window(text, start, end)]
    at = {(s, s + BODY) for s in range(start, end - BODY, STRIDE)} | {(end - BODY, end)}
    at |= {(m.start(), m.end()) for m in PIECE.finditer(text, start, end)}
    return [window(text, s, e) for s, e in sorted(at)]


@dataclass
class Network:
    """embedding -> convolution -> maximum over positions -> logistic output, with Platt scaling and a threshold."""

    embedding: np.ndarray
    kernel: np.ndarray
    kernel_bias: np.ndarray
    output: np.ndarray
    output_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        embedded = self.embedding[codes]  # n x width x d
        n, width, d = embedded.shape
        steps = width - SPAN + 1
        patches = np.lib.stride_tricks.sliding_window_view(embedded, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(n, steps, SPAN * d)
        maps = np.maximum(patches @ self.kernel + self.kernel_bias, 0)
        best = maps.argmax(axis=1)
        pooled = np.take_along_axis(maps, best[:, None, :], 1)[:, 0, :]
        body = codes[:, BEFORE : BEFORE + BODY]
        pooled = np.concatenate([pooled, shape_features(body)], axis=1)
        return patches, best, pooled, pooled @ self.output + self.output_bias

    def scores(self, windows: list[bytes]) -> np.ndarray:
        out = []
        for i in range(0, len(windows), 256):
            codes = SYMBOL[np.frombuffer(b"".join(windows[i : i + 256]), np.uint8).reshape(-1, WIDTH)]
            out.append(1 / (1 + np.exp(-np.clip(self.slope * self.forward(codes)[3] + self.shift, -40, 40))))
        return np.concatenate(out) if out else np.zeros(0)


def shape_features(body: np.ndarray) -> np.ndarray:
    """Share of digits, of capitals, of changes between classes, and the spread of characters in each candidate."""
    there = body > 0
    n = np.maximum(there.sum(1), 1)
    digit, upper = (body >= 28) & (body < 38), (body >= 15) & (body < 28)
    group = np.where(digit, 1, np.where(upper, 2, 3)) * there
    change = ((group[:, 1:] != group[:, :-1]) & there[:, 1:]).sum(1) / n
    spread = np.array([len(np.unique(row[row > 0])) for row in body]) / n
    return np.stack([digit.sum(1) / n, upper.sum(1) / n, change, spread, n / BODY], 1).astype(np.float32)


def labelled_findings(n: int, seed: int) -> tuple[list[bytes], np.ndarray]:
    """Findings with labels, made by rule: random keys in code and prose against identifiers, paths, dates, numbers and slugs."""
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(np.array(list(alphabet))[rng.integers(0, len(alphabet), k)])
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = lower + lower.upper() + digits
    word = lambda: "".join(pick("bcdfghklmnprstvz", 1) + pick("aeiou", 1) for _ in range(int(rng.integers(1, 4))))
    prose = lambda: " ".join(word() for _ in range(6))
    syllable = lambda: pick("bcdfghklmnprstvz", int(rng.integers(0, 3))) + pick("aeiou", int(rng.integers(1, 3))) + pick("cdhlmnrstg", int(rng.integers(0, 3)))
    compound = lambda: "".join(syllable() for _ in range(int(rng.integers(5, 9))))
    named = lambda style: (word(), word().upper(), word().title(), compound() if rng.random() < 0.6 else compound().title())[style]
    windows, labels = [], []
    for _ in range(n):
        secret = rng.random() < 0.5
        kind = int(rng.integers(0, 8))
        if secret:
            body = (pick(mixed, int(rng.integers(16, 48))), pick(mixed + "+/", 40) + "=", pick("abcdef" + digits, 32), word()[:3] + "_" + pick(mixed, 36), pick(lower.upper() + digits, 24), pick(mixed + "-_", int(rng.integers(20, 64))), pick(lower + lower.upper(), int(rng.integers(16, 48))), pick(mixed, int(rng.integers(16, 20))))[kind]
        else:
            body = ("-".join(word() for _ in range(5)) + "-" + pick(digits, 2), "_".join(word() for _ in range(4)) + pick(digits, 1), pick("2", 1) + "0" + pick(digits, 2) + "-0" + pick("123456789", 1) + "-" + pick("12", 1) + pick(digits, 1) + "-" + word() + "-" + word(), pick(digits, int(rng.integers(16, 20))), "/".join(word() for _ in range(5)) + "/" + pick(digits, 1), "=" * int(rng.integers(12, 30)) + pick(digits, 4), ("-", "_", "/")[int(rng.integers(0, 3))].join(named(int(rng.integers(0, 3))) for _ in range(6)), named(3) if rng.random() < 0.8 else pick("=-_/+", 1) * int(rng.integers(16, 60)))[kind]
            while len(body) < 16:
                body += word()

        lead = prose()
        if rng.random() < (0.5 if secret else 0.25):
            lead += " " + ("key", "token", "secret", "auth", "id", "name")[int(rng.integers(0, 4 if secret else 6))] + (" = ", ": ", '="')[int(rng.integers(0, 3))]
        else:
            lead += " "
        text = f"{lead}{body} {prose()}"
        windows.append(window(text, len(lead), len(lead) + len(body)))
        labels.append(secret)
    return windows, np.array(labels, np.float32)


@functools.lru_cache(maxsize=1)
def trained_network(n: int = 3000, epochs: int = 5, seed: int = 11) -> Network:
    """Train by stochastic gradient descent, calibrate on a second set, and set the threshold that keeps ``RECALL`` of a third set's secrets."""
    rng = np.random.default_rng(seed)
    d = 8
    net = Network(rng.normal(0, 0.3, (CLASSES, d)).astype(np.float32), rng.normal(0, 0.2, (SPAN * d, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, FILTERS + 5).astype(np.float32), 0.0)
    windows, labels = labelled_findings(n, seed)
    codes = SYMBOL[np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)]
    for epoch in range(epochs):
        rate = 0.2 / (1 + epoch)
        order = rng.permutation(n)
        for i in range(0, n, 32):
            batch = order[i : i + 32]
            patches, best, pooled, logits = net.forward(codes[batch])
            error = (1 / (1 + np.exp(-logits)) - labels[batch]) / len(batch)
            back = np.outer(error, net.output[:FILTERS]) * (pooled[:, :FILTERS] > 0)
            taken = np.take_along_axis(patches, best[:, :, None], 1)  # n x filters x patch
            kernel_step = np.einsum("nfp,nf->pf", taken, back)
            patch_step = back[:, :, None] * net.kernel.T[None]
            at = best[:, :, None] + np.arange(SPAN)[None, None]
            symbols = np.take_along_axis(codes[batch][:, None, :].repeat(FILTERS, 1), at, 2)
            embedding_step = np.zeros_like(net.embedding)
            np.add.at(embedding_step, symbols.ravel(), patch_step.reshape(-1, d))
            net.output -= rate * (pooled.T @ error)
            net.output_bias -= rate * float(error.sum())
            net.kernel -= rate * kernel_step
            net.kernel_bias -= rate * back.sum(0)
            net.embedding -= rate * embedding_step
    windows, labels = labelled_findings(1500, seed + 1)
    logits = net.forward(SYMBOL[np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)])[3]
    for _ in range(300):
        error = 1 / (1 + np.exp(-(net.slope * logits + net.shift))) - labels
        net.slope -= 0.05 * float((error * logits).mean())
        net.shift -= 0.05 * float(error.mean())
    windows, labels = labelled_findings(1500, seed + 2)
    secret = np.sort(net.scores(windows)[labels == 1])
    net.threshold = float(secret[int((1 - RECALL) * len(secret))])
    return net


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def free_parts(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidates, without what base spans cover; both go from left to right once."""
    taken: list[list[int]] = []
    for s, _, e in base:
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    first = 0
    for m in CANDIDATE.finditer(text):
        at = m.start()
        while first < len(taken) and taken[first][1] <= at:
            first += 1
        for s, e in itertools.takewhile(lambda span, end=m.end(): span[0] < end, itertools.islice(taken, first, None)):
            if key_like(text, at, s):
                yield at, s
            at = max(at, e)
        if key_like(text, at, m.end()):
            yield at, m.end()


def key_like(text: str, start: int, end: int) -> bool:
    return end - start >= LEAST and len(set(text[start:end])) >= DISTINCT


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", network: Network | None = None) -> DataFrame:
    """One row per row of ``df``: id, base and network spans.

    ``base`` and ``found`` are arrays of (kind, start, end, score), in code points, end exclusive. The
    network scores every candidate: what base spans match (their score, which drops none of them), and
    every other run of key characters, less what base spans cover; ``found`` has those that reach the
    threshold. A null or empty text has none; null ids and repeated rows give a row each; other
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    held = df.sparkSession.sparkContext.broadcast(network or trained_network())
    span = "array<struct<kind:string,start:int,end:int,score:double>>"
    out_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            base_out: list[list] = [[] for _ in range(batch.num_rows)]
            found_out: list[list] = [[] for _ in range(batch.num_rows)]
            pending: list[tuple[int, int, int, int]] = []
            windows: list[bytes] = []
            firsts: list[int] = []

            def judge(held: list, firsts: list, base_out=base_out, found_out=found_out):
                best = np.maximum.reduceat(net.scores(held), firsts) if firsts else []
                for (row, kind, s, e), score in zip(pending, best, strict=True):
                    if kind < 3:
                        base_out[row].append({"kind": KINDS[kind], "start": s, "end": e, "score": float(score)})
                    elif score >= net.threshold:
                        found_out[row].append({"kind": KINDS[3], "start": s, "end": e, "score": float(score)})
                for x in (pending, held, firsts):
                    x.clear()

            for row, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                base = base_spans(text)
                bodies = ((s, ASSIGN.match(text, s).start(2) if kind == 0 else s, kind, e) for s, kind, e in base)
                for s, body, kind, e in itertools.chain(bodies, ((s, s, 3, e) for s, e in free_parts(text, base))):
                    pending.append((row, kind, s, e))
                    firsts.append(len(windows))
                    windows += windows_of(text, body, e)
                    if len(windows) > HELD_WINDOWS:
                        judge(windows, firsts)
            judge(windows, firsts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_out, out_type), pa.array(found_out, out_type)], ["id", "base", "found"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id {kind}, base {span}, found {span}").withColumnRenamed("id", id_col)


def span_digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
