"""Licenses, secrets, benchmark passages and archives against brute force."""

import hashlib
import random
import re
import textwrap

import pytest
from prose import LOW, WORD, mutate, words

from roadloom.llm import decontaminate as dc
from roadloom.llm import license_scan as ls
from roadloom.llm import queries, secrets, warc


def test_license_scan(docs, corpus, nothing):
    got = {r.doc_id: r for r in ls.license_scan(docs).collect()}
    for i, t in corpus:
        w = WORD.findall((t or "").translate(LOW))
        places = [(n, label) for phrase, label in ls.PHRASES.items() for n in range(len(w)) if w[n : n + len(phrase.split())] == phrase.split()]
        labels = {label for _, label in places}
        starts = [n for n, _ in places]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        best = 1.0 if starts else 0.0
        for block in re.split(r"\n|[.!?;](?=\s)", (t or "").translate(LOW)):
            held = set(WORD.findall(block))
            for label, template in ls.TEMPLATES:
                want = set(ls.words_of(template))
                if len(held & want) >= ls.THRESHOLD * len(want) - 1e-9:
                    labels.add(label)
                    best = max(best, len(held & want) / len(want))
        assert (r.labels, r.score) == (",".join(sorted(labels)), best)
    assert ls.license_scan(nothing).count() == 0


def test_templates_need_most_of_their_words(spark):
    rows = [(0, "you may not use this file except in compliance with the license"), (1, "you may use the file with license"), (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files")]
    got = {r.doc_id: r.labels for r in ls.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: "apache", 1: "", 2: "mit"}


def test_wrapped_statements(spark):
    """Each template wrapped at several widths, with comment marks, far into a text; not where its words are far apart or in different paragraphs."""
    rows, want = [], {}
    filler = " ".join(f"w{i}" for i in range(70))
    for label, template in ls.TEMPLATES:
        for width, mark in ((24, ""), (40, " * "), (30, "rem "), (36, "// ")):
            lines = textwrap.wrap(f"{filler} {template} {filler}", width)
            want[len(rows)] = label
            rows.append((len(rows), "\r\n".join(mark + x for x in lines)))
        words = ls.words_of(template)
        if len(words) >= 10:
            if not any(phrase in " ".join(words) for phrase in ls.PHRASES):
                want[len(rows)] = None
                rows.append((len(rows), "\n\n".join(words)))
            want[len(rows)] = None
            rows.append((len(rows), f"\n{filler}\n{filler}\n".join(words)))
    got = {r.doc_id: r.labels.split(",") for r in ls.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, label in want.items():
        assert label in got[i] if label else got[i] == [""], rows[i]


def test_secret_spans(docs, corpus, nothing, tmp_path, spark):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op5_secrets(spark, str(tmp_path)).collect()}
    for i, t in corpus:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 16]
        found.sort()
        r = got[i]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in found) for x in range(3))
        assert [x for x in r.spans.split(",") if x and not x.startswith("network")] == [x for x in text.split(",") if x]
    assert secrets.secret_spans(nothing).count() == 0


def test_network_keeps_the_recall_on_new_findings():
    net = secrets.trained_network()
    windows, labels = secrets.labelled_findings(1000, 12345)
    scores = net.scores(windows)
    assert (scores[labels == 1] >= net.threshold).mean() >= 0.95
    assert (scores[labels == 0] >= net.threshold).mean() <= 0.05


def test_keys_without_digits_and_short_keys_are_found():
    """Recall over candidate search and network together."""
    rng = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    net = secrets.trained_network()
    for alphabet, low, high in ((letters, 24, 40), (letters, 16, 19), (letters + "0123456789", 16, 19)):
        seen = []
        for _ in range(300):
            key = "".join(rng.choices(alphabet, k=rng.randint(low, high)))
            text = f"they said auth = {key} and went"
            found = [(m.start(), m.end()) for m in secrets.CANDIDATE.finditer(text)]
            seen.append(found == [(17, 17 + len(key))] and net.scores([secrets.window(text, *found[0])])[0] >= net.threshold)
        assert sum(seen) >= 0.95 * len(seen), (alphabet, low)


def test_keys_within_long_runs_are_seen(spark):
    rng = random.Random(23)
    rows = []
    for i in range(60):
        key = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=32))
        path = ["/".join(rng.choices(["lemo", "data", "papi", "roze", "kila", "suma"], k=14)) for _ in range(2)]
        rows += [(2 * i, f"see {path[0]}/{key}/{path[1]} there"), (2 * i + 1, f"see {path[0]}/{path[1]} there")]
    got = {r.doc_id: bool(r.found) for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[2 * i] for i in range(60)) >= 57 and sum(got[2 * i + 1] for i in range(60)) <= 6


def test_threshold_is_the_quantile():
    net = secrets.trained_network()
    windows, labels = secrets.labelled_findings(1500, 13)
    kept = (net.scores(windows)[labels == 1] >= net.threshold).mean()
    assert secrets.RECALL <= kept <= secrets.RECALL + 0.005


def test_network_adds_spans(spark):
    rng = random.Random(3)
    key = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=40))
    rows = spark.createDataFrame([(1, f"auth = {key} of the house"), (2, "see the-long-slug-of-a-page-12 for more")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in secrets.secret_spans(rows).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1].found] == [("network", 7, 47)] and got[2].found == []


def distance(a, b):
    """Least edits between a and any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randint(8, 30))).capitalize() + ".") for i in range(12)] + [(50, ""), (51, "Ab"), (52, None)]
    texts = []
    for i in range(30):
        parts = [" ".join(words(rng, 40)), " ".join(words(rng, 25))]
        if i % 2:
            parts.insert(1, mutate(rng, items[i % 12][1], i % 4).upper() if i % 3 else items[i % 12][1].replace(" ", ",\n", 2))
        texts.append((i, "\n".join(parts)))
    return items, [*texts, (90, None), (91, ""), (92, items[0][1] * 3), (92, items[0][1] * 3)]


def test_decontamination(spark, leaks, nothing):
    items, texts = leaks
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for i, t in texts:
        for j, item in items:
            a, b = dc.normalise(item), dc.normalise(t)
            if a:
                d = distance(a, b)
                if d <= int(0.08 * len(a)):
                    want.append((i, j, d))
    assert any(d for _, _, d in want)
    for block in (dc.BLOCK_CHARS, 300):
        got = dc.contaminated(docs, bench, block_chars=block).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == sorted(want)
    assert dc.contaminated(docs, bench.limit(0)).count() == 0 and dc.contaminated(nothing, bench).count() == 0


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(1, 90))) for _ in range(2))
        assert dc.myers(dc.bits_of(a), len(a), b, 0, len(b))[0] == distance(a, b)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def expected(rows):
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    out = {}
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= warc.REVISIT_BYTES and first[h] != i
        out[i] = (len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None)
    return out


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello"


def odd_pages():
    rng = random.Random(4)
    rows = [(i, f"http://x/{i}", " ".join(words(rng, rng.randint(0, 300)))) for i in range(60)]
    same = "w" * 150
    rows += [(100 + i, None, same) for i in range(20)] + [(90, "a\r\nb: c", same), (91, "", "short"), (92, "", "short")]
    ends = ["", "\r\n", "\r\n\r\n", "\r\n\r\n\r\n", "\n", "\r", "\r\n\r"]
    rows += [(200 + 10 * a + b, "u", x + body + y) for a, x in enumerate(ends) for b, (y, body) in enumerate(zip(ends, [FAKE, "b", FAKE * 2, "é☃", "", FAKE + "\r\n\r\n" + FAKE, "WARC/1.1"], strict=True))]
    rows += [(300, "u", None), (301, "u", "long " * 100_000), (302, "u", "\r\n\r\n".join([FAKE] * 50))]
    return rows


def test_warc_round_trip(spark):
    rows = odd_pages()
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages(spark, rows).repartition(3)).collect()}
    assert got == expected(rows)
    assert warc.warc_round_trip(pages(spark, [])).count() == 0


def test_warc_in_small_splits(spark, tmp_path):
    """Splits that cut headers, payloads and breaks anywhere give the same records, and a file as a whole is a WARC file."""
    rows = odd_pages()
    path = f"file://{tmp_path}/archive"
    warc.write_warc(pages(spark, rows).coalesce(1), path)
    data = next((tmp_path / "archive").glob("part-*")).read_bytes()
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    whole = sorted((r.at, r.content_digest, r.type, r.id or 0) for r in warc.read_warc(spark, path).collect())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (4001, 60_013):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            assert sorted((r.at, r.content_digest, r.type, r.id or 0) for r in warc.read_warc(spark, path).collect()) == whole
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(whole) == len(rows)


def test_every_candidate_is_scored(spark):
    from roadloom.llm import secrets as sc

    key = "Zq8vT3xKp0LmR7sWb2Yd9Nc4"
    texts = [f"token = {key} and AKIA{'7Q' * 8} then {key}", "AKIA" + "A1" * 8 + "-" + key + "/rest", "x" * 3000 + " " + key, None, ""]
    rows = spark.createDataFrame([(None if i == 3 else i, t, "kept out") for i, t in enumerate(texts)], "doc_id bigint, text string, BASE string")
    found = {r.doc_id: r for r in sc.secret_spans(rows).collect()}
    assert [(b.kind, b.start, b.end) for b in found[0].base] == [("assign", 0, 8 + len(key)), ("access", 37, 57)]
    assert all(0 < b.score <= 1 for b in found[0].base)  # the network's, not a constant
    assert [(f.start, f.end) for f in found[0].found] == [(63, 63 + len(key))]
    assert [(b.kind, b.end) for b in found[1].base] == [("access", 20)]
    assert [texts[1][f.start : f.end].strip("-") for f in found[1].found] == [key + "/rest"]  # the rest of a run that a base span begins
    assert [(f.start, f.end) for f in found[2].found] == [(3001, 3001 + len(key))]
    assert found[None].base == [] and found[4].found == []


def test_free_parts_are_found_in_one_pass():
    import random
    import time

    from roadloom.llm import secrets as sc

    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdef0123456789", k=20)) + rng.choice(("", "-" + "QWERTYUIOPASDFGHJKLZ")) for _ in range(40_000))
    base = sc.base_spans(text)
    began = time.perf_counter()
    parts = list(sc.free_parts(text, base))
    assert len(base) >= 40_000 and time.perf_counter() - began < 5
    covered = bytearray(len(text))
    for s, _, e in base:
        covered[s:e] = b"\1" * (e - s)
    assert parts and all(not any(covered[s:e]) and e - s >= sc.LEAST for s, e in parts)
