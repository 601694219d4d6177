"""Language model, quality classifier, packing and the pipeline."""

import collections
import math
import random
import re
import zlib

import pytest
from prose import LOW, sentence_text, words

from roadloom.llm import lm_score, packing, quality, queries

TOKEN = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [*TOKEN.findall((text or "").translate(LOW)), None]


@pytest.mark.parametrize("top", [lm_score.TOP_WORDS, 20])
def test_lm_scores(docs, corpus, nothing, monkeypatch, top):
    monkeypatch.setattr(lm_score, "TOP_WORDS", top)  # few broadcast words: most counts come by the shuffle
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in corpus}
    counts = collections.Counter(x for i, t in corpus if not held[i] for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm_score.lm_scores(docs).collect()}
    assert set(got) == set(held)
    for i, t in corpus:
        r, ts = got[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(counts[x] > 0 for x in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts), abs=1e-6)
        assert r.score <= 0 and math.isfinite(r.score)
    assert lm_score.lm_scores(nothing).count() == 0


def test_lm_learns_from_context(spark):
    rng = random.Random(2)
    cycle = words(rng, 12)
    rows = [(i, " ".join(cycle[(i + k) % 12] for k in range(40))) for i in range(300)]
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)


def test_lm_learns_which_word_of_many_follows(spark, monkeypatch):
    """Each of 600 equally frequent words has one successor, which only a model of the words themselves can favour; with few broadcast words, too."""
    rng = random.Random(4)
    cycle = list(dict.fromkeys(words(rng, 3000)))[:600]
    starts = [rng.randrange(600) for _ in range(1200)]
    rows = [(i, " ".join(cycle[(s + k) % 600] for k in range(40))) for i, s in enumerate(starts)]
    for top in (lm_score.TOP_WORDS, 100):
        monkeypatch.setattr(lm_score, "TOP_WORDS", top)
        got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()
        assert sum(r.score for r in got) > 0.4 * sum(r.base_score for r in got)


def test_lm_grows_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "LEAST_BITS", 6)
    rng = random.Random(5)
    small = [(" ".join(f"w{rng.randrange(2000)}" for _ in range(100)),) for _ in range(50)]
    large = [(" ".join(f"w{rng.randrange(200_000)}" for _ in range(1000)),) for _ in range(500)]
    models = []
    for rows in (small, large):
        train = spark.createDataFrame(rows, "text string")
        models.append(lm_score.fit(train, lm_score.word_counts(train).cache())[0])
    assert len(models[1].weights) >= 4 * len(models[0].weights)
    assert len(models[1].nodes) > 20 * len(models[0].nodes) and models[1].hash_bits > 0


def test_lm_probabilities_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(3)
    tokens = np.sort(rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2))
    model = lm_score.Model(tokens, np.ones(200), *lm_score.tree(rng.integers(1, 500, 200).astype(float), 40.0), 3, rng.normal(0, 1, 1 << 12).astype(np.float32))
    leaves = np.arange(8, dtype=np.uint64) << np.uint64(61)  # one unbroadcast word for each leaf of the others
    every = np.r_[tokens, leaves + np.uint64(1)]
    same = [np.tile(f, len(every)) for f in np.array([[5], [1 << 31], [7]], np.uint32)]
    cost = np.zeros(len(every))
    for token, sign, logits, _ in model.decisions(every, model.find(every), same):
        cost += np.bincount(token, weights=np.logaddexp(0, sign * logits), minlength=len(every))
    p = np.exp(-cost)
    assert abs(p.sum() - 1) < 1e-4


def junk(rng, n):
    kind = rng.randint(0, 2)
    w = words(rng, n)
    return (" ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join(x + rng.choice(["%%%", "&&&", "$$$"]) for x in w))[kind]


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(6)
    rows = [(i, sentence_text(rng, rng.randint(30, 90)) if i % 4 else junk(rng, rng.randint(30, 90))) for i in range(400)]
    return rows, [(i, int(i % 4 > 0)) for i, _ in rows]


def test_quality(spark, labelled, nothing):
    rows, labels = labelled
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in [*rows, (1000, None), (1001, "")]], "doc_id bigint, text string, score double")
    table = spark.createDataFrame([*labels, (0, None), (None, 1), (5000, 1)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, table).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i, _ in rows)
    assert sum(got[i].predicted == dict(labels)[i] for i in held) >= 0.95 * len(held)
    assert got[1000].score == got[1001].score and 0 <= got[1000].score <= 1
    flipped = spark.createDataFrame([(i, 1 - q if i in held else q) for i, q in labels], "doc_id bigint, quality int")
    assert {r.doc_id: r.score for r in quality.quality_scores(docs, flipped).collect()} == {i: r.score for i, r in got.items()}
    assert quality.quality_scores(nothing, table).count() == 0
    assert quality.quality_scores(docs, table.limit(0)).first().score == 0.5


def test_scores_do_not_depend_on_neighbours(labelled):
    import numpy as np
    import pyarrow as pa

    from roadloom.llm import textscan as ts

    rows, labels = labelled
    model = quality.train([t for _, t in rows[:100]], [q for _, q in labels[:100]])
    data, offsets = ts.text_buffers(pa.array([t for _, t in rows[100:140]] + [None, "", "x"]))
    together = model.score(data, offsets)
    alone = [model.score(*ts.text_buffers(pa.array([t])))[0] for t in [t for _, t in rows[100:140]] + [None, "", "x"]]
    assert np.allclose(together, alone)


def test_packing(docs, corpus, nothing, spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path, window=512, bucket_pieces=40).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in corpus}
    seen = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
        piece = b"".join(x.to_bytes(4, "little") for x in ids[r.doc_id][r.start : r.start + r.length])
        assert zlib.crc32(piece) == r.ids_crc32
    assert dict(seen) == {i: len(x) for i, x in ids.items()}
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 512
    assert len(windows) <= sum(seen.values()) / 512 + 12
    assert packing.pack(nothing, path).count() == 0


ODD = [" ".join(f"ab{chr(c)}cd {chr(c)} {chr(c)}{chr(c)}x," for c in range(0xC0, 0x100)), "it's we'll", "<|endoftext|> <|ENDOFTEXT|>", "a\x1cb\x85c d", "ÀÉ ÷× naïve!!", "é É.", "don't. stop... 12,5 ☃☃", "ΣΑΣ Straße İ", "x y\x0bz\x0cw", "café... déjà-vu;", "a" * 500]


def test_ids_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer, own = Tokenizer.from_file(path), packing.WordIds(path)
    for text in [*ODD, " ".join(ODD), "\n".join(ODD).upper()]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert own.encode(text, b"") == b"".join(x.to_bytes(4, "little") for x in ids), text


def test_best_fit_decreasing_against_a_list():
    rng = random.Random(9)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    windows, offsets = packing.best_fit_decreasing(lengths, 100)
    left, place = [], {}
    for i in sorted(range(500), key=lambda i: -lengths[i]):
        fits = [x for x in left if x >= lengths[i]]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - lengths[i])
        else:
            left.append(100 - lengths[i])
    for i, (w, o) in enumerate(zip(windows, offsets, strict=True)):
        place.setdefault(w, []).append((o, lengths[i]))
    assert sorted(100 - sum(n for _, n in p) for p in place.values()) == sorted(left)


def test_pipeline(spark, tmp_path, labelled):
    import corpus_pipeline as cp

    rows, labels = labelled
    rng = random.Random(12)
    item = " ".join(words(rng, 25))
    clean = [i for i, _ in rows if i % 4]
    extra = [(600, dict(rows)[1]), (601, sentence_text(rng, 40) + "\n" + item), (602, sentence_text(rng, 300)), (603, None), (604, sentence_text(rng, 60))]
    extra.append((605, extra[2][1].replace("a", "e", 1)))
    full = [(i, t, "en", "src", len(t or ""), 0.1) for i, t in rows + extra]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        found.write.parquet(path)
        docs = spark.read.parquet(path)
    left = {r.doc_id: r.text for r in docs.collect()}
    assert len(set(clean) & set(left)) >= 0.97 * len(clean)
    assert not [i for i, _ in rows if i % 4 == 0 and i in left][3:]
    assert 601 not in left and 602 in left and 604 in left
    assert not left.get(600)  # all its lines stand in another document
    assert "\n" not in left.get(605, "")  # all but the changed one
    packed = cp.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(left)
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_stages_decide_by_row(spark, tmp_path):
    """Null and repeated ids: what was hit goes, and nothing that shares its id."""
    import corpus_pipeline as cp

    rng = random.Random(21)
    item, text = " ".join(words(rng, 25)), [sentence_text(rng, 60) for _ in range(4)]
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(stage, rows):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()), key=str)

    clean = [(1, text[0]), (None, text[1]), (2, None), (None, None)]
    assert left(cp.drop_contaminated, [*clean, (None, text[2] + " " + item), (1, item)]) == sorted(clean, key=str)
    kept = [(1, text[0]), (5, text[1]), (None, text[0]), (None, text[2])]
    assert left(cp.drop_near_duplicates, [*kept, (5, text[0])]) == sorted(kept, key=str)


def test_quality_of_clashing_names_and_text_ids(spark):
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, quality int")
    texts = [("plain words in a row " if i % 2 else "@@ ## !! ") * 5 for i in range(40)]
    rows = spark.createDataFrame([(f"d{i}", t, 0.5, "x") for i, t in enumerate(texts)] + [(None, None, 0.5, "x"), ("d1", texts[1], 0.5, "x")], "doc_id string, score string, Score_ double, HELD_OUT string")
    from roadloom.llm import quality

    got = quality.quality_scores(rows, labels, text_col="score")
    assert got.columns == ["doc_id", "Score_", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == 42 and all(0 <= r.score <= 1 for r in found)
    assert [r.held_out for r in found if r.doc_id is None] == [False]
