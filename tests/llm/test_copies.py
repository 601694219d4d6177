"""Exact, line and n-gram duplicates against brute force."""

import collections
import hashlib
import random
import re

import pytest
from prose import LOW, WORD
from pyspark.sql import functions as F

from roadloom.llm import cluster
from roadloom.llm import exact_dedup as ed
from roadloom.llm import line_dedup as ld
from roadloom.llm import ngram_join as nj
from roadloom.llm.components import connected_components


def classes(keys, linked):
    """Smallest key of each component."""
    parent = {x: x for x in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in keys}


def jaccard_links(sets, threshold):
    items = sorted(sets)
    for i, a in enumerate(items):
        for b in items[:i]:
            x, y = sets[a], sets[b]
            if len(x) * threshold <= len(y) <= len(x) / threshold:
                common = len(x & y)
                if common >= threshold * (len(x) + len(y) - common) - 1e-9:
                    yield b, a


@pytest.mark.parametrize("counters", [4, 1024])
def test_exact_dedup(docs, corpus, counters):
    groups = collections.defaultdict(list)
    for i, t in corpus:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    want = {}
    for text, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            want[i] = (keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ed.exact_dedup(docs, counters=counters).collect()}
    assert got == want


def test_exact_dedup_of_odd_rows(spark, nothing):
    assert ed.exact_dedup(nothing).count() == 0
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a "), (2, "b")], "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in ed.exact_dedup(rows).collect())
    assert got == [(False, 1, None, 3, False), (False, 1, None, 3, False), (False, 2, 2, 1, True), (True, 0, None, 3, True)]


def test_misra_gries_keeps_every_frequent_value():
    summary = ed.MisraGries(3)
    for i in range(300):
        summary.add([f"v{i}", "hot"], [1, 2])
    assert len(summary.counts) <= 3 and summary.counts["hot"] >= 600 - 900 / 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {x for e in edges for x in e if e[0] is not None and e[0] != e[1]}
    assert got == classes(nodes, [e for e in edges if e[0] is not None])
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text, k=ld.SHINGLE):
    units = text.encode("utf-16-be")
    return {units[2 * i : 2 * (i + k)] for i in range(max(1, len(units) // 2 - k + 1))}


@pytest.mark.parametrize("broadcast", [cluster.BROADCAST_ROWS, 0])
def test_line_classes(docs, corpus, monkeypatch, broadcast):
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", broadcast)
    lines = [(i, n, x) for i, t in corpus for n, x in enumerate((t or "").split("\n"))]
    places = collections.defaultdict(list)
    for i, n, x in lines:
        if x.strip(" \t\r\x0b\x0c"):
            places[x].append((i, n))
    merged = classes(places, jaccard_links({x: shingles(x) for x in places}, ld.THRESHOLD))
    members = collections.defaultdict(list)
    for x, c in merged.items():
        members[c] += places[x]
    want = {(i, n): (i, n, 1, True) for i, n, x in lines}
    for m in members.values():
        first = min(m)
        for at in m:
            want[at] = (*first, len(m), at == first)
    got = {(r.doc_id, r.line_no): (r.rep_id, r.rep_line_no, r.class_size, r.kept) for r in ld.line_classes(docs).collect()}
    assert got == want
    kept = {r.doc_id: r for r in ld.dedup_lines(docs).collect()}
    assert set(kept) == {i for i, _ in corpus} and list(kept[0].asDict()) == docs.columns
    for i, t in corpus:
        assert kept[i].text == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if want[i, n][3]))


def test_short_lines_share_a_band(spark):
    """Lines of 10 and 8 shingles, 8 of them common: similarity 0.8."""
    rng = random.Random(31)
    pairs = 4000
    rows = []
    for p in range(pairs):
        line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=17))
        rows += [(2 * p, line), (2 * p + 1, line[:15])]
    keys = collections.defaultdict(set)
    for r in ld.line_keys(spark.createDataFrame(rows, "line_id bigint, line string")).collect():
        keys[r.line_id].update(r["keys"])
    assert sum(bool(keys[2 * p] & keys[2 * p + 1]) for p in range(pairs)) > 0.98 * pairs


def test_family_of_near_copies(spark):
    """2,000 copies of one line with several words changed each, many pairs of which are just under the threshold."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz\u00e9\U0001f600", k=rng.randint(3, 9)))
    base = [word() for _ in range(30)]
    lines = []
    for _ in range(2000):
        mine = list(base)
        for at in rng.sample(range(30), rng.randint(1, 4)):
            mine[at] = word()
        lines.append(" ".join(mine))
    want = classes(range(2000), jaccard_links(dict(enumerate(map(shingles, lines))), ld.THRESHOLD))
    got = {r.doc_id: r.rep_id for r in ld.line_classes(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()}
    assert len(set(want.values())) > 3 and sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_lines_of_odd_rows(spark, nothing):
    assert ld.line_classes(nothing).count() == 0 and ld.dedup_lines(nothing).count() == 0
    rows = spark.createDataFrame([(None, "one line of some length"), (3, "one line of some length"), (3, None)], "doc_id bigint, text string")
    assert sorted(str(r.text) for r in ld.dedup_lines(rows).collect()) == ["", "None", "one line of some length"]


def test_line_dedup_uses_no_python(docs):
    plan = ld.line_keys(ld.explode_lines(docs, "doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def grams(text, n=5):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_ngram_join(docs, corpus, monkeypatch):
    sets = {i: grams(t) for i, t in corpus}
    linked = list(jaccard_links({i: s for i, s in sets.items() if s}, 0.8))
    empty = [i for i, s in sets.items() if not s]
    linked += [(a, b) for a in empty for b in empty if a < b]
    want = classes(sets, linked)
    count = collections.Counter(x for pair in linked for x in pair)
    for block in (nj.BLOCK_DOCS, 3):  # the second cuts components into many blocks
        monkeypatch.setattr(nj, "BLOCK_DOCS", block)
        got = {r.doc_id: (r.class_id, r.n_links) for r in nj.ngram_jaccard_join(docs).collect()}
        assert got == {i: (want[i], count[i]) for i in sets}


def test_ngram_join_of_odd_rows(spark, nothing):
    assert nj.ngram_jaccard_join(nothing).count() == 0
    rows = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (5, "other words here"), (None, "a b c"), (9, "A, b c!")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in nj.ngram_jaccard_join(rows).collect())
    assert got == [(0, None, 0), (5, 5, 0), (5, 5, 2), (5, 5, 2), (9, 5, 2)]


def test_bands_meet_the_recall():
    bands = nj.bands_for(0.8, 0.999, 6)
    assert 1 - (1 - 0.8**6) ** bands >= 0.999 > 1 - (1 - 0.8**6) ** (bands - 1)


@pytest.mark.parametrize("grams", [5, 10, 20])
def test_recall_on_small_sets(spark, grams):
    """Pairs at the threshold among short texts, each of ``grams`` n-grams together, of which four fifths are common."""
    pairs = 2000
    rows = []
    for p in range(pairs):
        names = [f"w{p}x{k}" for k in range(grams)]
        rows += [(2 * p, " ".join(names)), (2 * p + 1, " ".join(names[: grams * 4 // 5]))]
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), n=1)
    assert got.where("n_links = 1").count() >= 0.9965 * 2 * pairs


def test_columns_stay(docs):
    assert ld.dedup_lines(docs.withColumn("dropped_lines", F.lit(1))).columns == [*docs.columns, "dropped_lines"]


def test_ngram_join_of_text_ids(spark):
    rows = spark.createDataFrame([("b", "one two three four five six"), ("a", "One two three four five six!"), ("c", None)], "doc_id string, text string")
    assert sorted(map(tuple, nj.ngram_jaccard_join(rows).collect())) == [("a", "a", 1), ("b", "a", 1), ("c", "c", 0)]


def test_signatures_are_aggregated_in_a_map_that_holds_all_groups(spark, monkeypatch):
    name = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
    before, seen = spark.conf.get(name), []
    made = ld.line_keys
    monkeypatch.setattr(ld, "line_keys", lambda lines: seen.append(spark.conf.get(name)) or made(lines))
    docs = spark.createDataFrame([(1, "one line of text"), (2, "one line of text\nanother line")], "doc_id bigint, text string")
    assert ld.line_classes(docs).where("not kept").count() == 1
    assert seen == ["20"] and spark.conf.get(name) == before


def test_white_space_is_told_from_the_left_only(spark):
    texts = ["", " \t\r\x0b\x0c", " x", "x ", " ", "\t  "]
    lines = ld.explode_lines(spark.createDataFrame([(1, "\n".join(texts))], "doc_id bigint, text string"), "doc_id", "text")
    assert [r.line_id is None for r in lines.orderBy("line_no").collect()] == [True, True, False, False, False, False]
    assert " trim(" not in lines._jdf.queryExecution().analyzed().toString()
