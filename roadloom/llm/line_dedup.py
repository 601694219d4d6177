"""Fuzzy line deduplication by MinHash, in DataFrame functions alone."""

from __future__ import annotations

import random
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.cluster import discard, fresh, met, stored, within
from roadloom.llm.components import connected_components

#: Characters of a shingle, as UTF-16 counts them: one beyond the basic plane is two.
SHINGLE = 8
#: A line's shingles fall to ``PARTS`` by their hash, so that each meets the minima of its part only; every part has
#: ``BANDS`` bands of ``ROWS`` minima. Two lines at similarity 0.8 share a band with probability 0.985, at 0.85 with
#: 0.997, at 0.5 with 0.4.
PARTS, BANDS, ROWS = 4, 2, 4
THRESHOLD = 0.8
#: In buckets, pairs are compared by sets of 32-bit hashes; what comes within so much of the threshold is compared again by 64 bits.
SLACK = 0.01


def explode_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line, line_id) of every line; line_id is null for a line of white space."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line"))
    # From the left only, which ends at the first other character; from the right all characters are listed first.
    return lines.withColumn("line_id", F.when(F.ltrim("line", F.lit(" \t\r\x0b\x0c")) != "", F.xxhash64("line")))


@contextmanager
def roomy_aggregation(spark: SparkSession) -> Iterator[None]:
    """Let the generated hash map of an aggregation hold all groups of a task (2^20 instead of 2^16); the general map behind it is slower."""
    name = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "20")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def line_keys(lines: DataFrame) -> DataFrame:
    """(line_id, keys): one key for each band of each distinct line, a row for each part.

    Two bytes a character let a shingle be cut anywhere without a search from the start of the line.
    Minima are aggregated before the shuffle. A line without a shingle in a part has no band there.
    """
    found = lines.where("line_id is not null").select("line_id", F.encode("line", "UTF-16BE").alias("units"))
    found = found.select("line_id", "units", F.explode(F.expr(f"sequence(1, greatest(octet_length(units) - {2 * SHINGLE - 2}, 1), 2)")).alias("at"))
    found = found.select("line_id", F.expr(f"hash(substring(units, at, {2 * SHINGLE}))").alias("h"))
    rng = random.Random(20240305)
    minima = [F.min(F.col("h").bitwiseXOR(F.lit(rng.getrandbits(32) - (1 << 31)))).alias(f"m{i}") for i in range(BANDS * ROWS)]
    signatures = found.groupBy("line_id", F.expr(f"cast(h & {PARTS - 1} as tinyint)").alias("part")).agg(*minima)
    bands = F.array(*(F.xxhash64("part", F.lit(i), *(f"m{j}" for j in range(i * ROWS, (i + 1) * ROWS))) for i in range(BANDS)))
    return signatures.select("line_id", bands.alias("keys"))


def shingles(line: str, hashed: str = "xxhash64") -> Column:
    """The hashes of the set of shingles of a line; a shorter line is its own."""
    units = F.encode(line, "UTF-16BE")

    def cut(units: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(units) - (2 * SHINGLE - 2), F.lit(1)), F.lit(2))
        return F.transform(starts, lambda i: F.call_function(hashed, F.substring(units, i, F.lit(2 * SHINGLE))))

    return F.array_distinct(F.flatten(F.transform(F.array(units), cut)))  # the one-element array binds the units


def similar(x: Column, y: Column, threshold: float) -> Column:
    common = F.size(F.array_intersect(x, y))
    least = threshold / (1 + threshold)
    sizes = F.size(x) + F.size(y)
    # Sets of too different sizes need no intersection.
    return (F.least(F.size(x), F.size(y)) >= threshold * F.greatest(F.size(x), F.size(y)) - 1e-9) & (common >= least * sizes - 1e-9)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of line ids whose sets of shingles have a Jaccard similarity of at least ``threshold``.

    Lines travel as text, which is shorter than their sets; each pair makes its two, once, since the
    verdict is written before it is filtered by.
    """
    sides = [texts.select(F.col("line_id").alias(c), F.col("line").alias(f"line_{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", shingles("line_a").alias("x"), shingles("line_b").alias("y"))
    return stored(both.select("a", "b", similar(F.col("x"), F.col("y"), threshold).alias("linked")), "verdicts").where("linked").select("a", "b")


def line_components(lines: DataFrame, threshold: float) -> DataFrame:
    """(line_id, root) of every distinct line that is similar to another.

    Lines that share a band are compared with the first line of their bucket; what is similar merges. Where a bucket still has several components, every pair of different components
    there is compared inside the join, in the least bucket that the two share; only similar ones leave
    it, so that a large group of near copies is never listed pair by pair and no link is lost.
    """
    with roomy_aggregation(lines.sparkSession):
        signatures = stored(line_keys(lines), "keys")
    keys = signatures.select("line_id", F.explode("keys").alias("key"))
    # A line has each of its keys once.
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("first")).where("n > 1").select("key", "first")
    members = stored(keys.join(within(stored(buckets, "buckets")), "key"), "members")
    discard(signatures)
    needed = stored(members.select("line_id").distinct(), "needed")
    texts = stored(lines.select("line_id", "line").join(within(needed), "line_id").groupBy("line_id").agg(F.first("line").alias("line")), "texts")

    others = members.where("line_id != first")
    pairs = others.select(F.col("first").alias("a"), F.col("line_id").alias("b")).distinct()
    edges = verified(pairs, texts, threshold)
    roots = connected_components(edges)

    # The first line of each bucket has met all others.
    large = met(others.select("key", "line_id"), roots.withColumnRenamed("node", "line_id"), "line_id", "key").withColumn("root", F.coalesce("root", "line_id"))
    counted = large.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    split = counted.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "main")
    opened = stored(met(large, stored(split, "split"), "key", "line_id").where("main is not null").select("key", "line_id", "root", "main"), "opened")
    if not opened.limit(1).count():
        return roots.withColumnRenamed("node", "line_id")
    # A line has at most as many keys as there are bands.
    shared = opened.groupBy("line_id").agg(F.collect_list("key").alias("keys"))
    both = stored(shared.join(texts, "line_id").select("line_id", "keys", shingles("line", "hash").alias("held")), "open-sets")
    rows = opened.join(both, "line_id").select("key", "main", F.struct("line_id", "root", "keys", "held").alias("x"))
    x, y = rows.where("x.root != main"), rows.select("key", F.col("main").alias("main_y"), F.col("x").alias("y"))
    once = (F.col("x.line_id") < F.col("y.line_id")) | (F.col("y.root") == F.col("main_y"))
    here = F.array_min(F.array_intersect("x.keys", "y.keys")) == x["key"]
    near = similar(F.col("x.held"), F.col("y.held"), threshold - SLACK)
    found = x.join(y, (x["key"] == y["key"]) & (F.col("x.root") != F.col("y.root")) & once & here & near)
    found = found.select(F.least("x.line_id", "y.line_id").alias("a"), F.greatest("x.line_id", "y.line_id").alias("b"))
    more = verified(stored(found, "found"), texts, threshold)
    if more.limit(1).count():
        roots = connected_components(edges.unionAll(more))
    return roots.withColumnRenamed("node", "line_id")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per line of every text: id, line_no (from 0), rep_id, rep_line_no, class_size, kept.

    Lines end at line feeds. Two lines are similar when their sets of shingles of 8 characters have a
    Jaccard similarity of at least ``threshold`` (a shorter line is its own shingle); classes are the
    connected components. The occurrence of least id, then line number, stays and represents its
    class; a null id is least. A line of white space stays, as a class of its own. A null or empty
    text is one empty line. Rows repeated with one id share their decisions. Other columns are not
    read; an empty table gives no rows. Equal lines and shingles are told by 64-bit hashes.
    """
    lines = explode_lines(docs, id_col, text_col)
    roots = line_components(lines, threshold)
    at = met(lines.select("id", "line_no", "line_id"), roots, "line_id", "id").select("id", "line_no", F.coalesce("root", "line_id").alias("class"))
    at = stored(at, "lines")
    first = F.min(F.struct(F.col("id").alias("rep_id"), F.col("line_no").alias("rep_line_no")))
    classes = at.where("class is not null").groupBy("class").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1")
    out = met(at, stored(classes, "classes"), "class", "id")
    rep_id = F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.rep_id"))
    out = out.select("id", "line_no", rep_id.alias("rep_id"), F.coalesce("first.rep_line_no", "line_no").alias("rep_line_no"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
    kept = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("line_no") == F.col("rep_line_no"))
    return out.withColumn("kept", kept).withColumnRenamed("id", id_col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every line dropped from the text that ``line_classes`` doesn't keep; all rows and columns stay.

    A text that loses nothing is returned as it was, a null as null; one that loses all is empty.
    """
    gone, own = fresh(docs, "dropped_lines"), fresh(docs, "dropped_id")
    dropped = line_classes(docs, id_col, text_col, threshold).where("not kept").groupBy(F.col(id_col).alias(own)).agg(F.collect_set("line_no").alias(gone))
    dropped = stored(dropped, "dropped")
    joined = docs.join(dropped, F.col(id_col).eqNullSafe(F.col(own)), "left")
    # Numbered lines less numbered lines: one hash set, however many are dropped. The one-element array binds the lines.
    whole = F.array(F.split(F.col(text_col), "\n"))
    text = F.transform(whole, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: x[i]), "\n"))[0]
    return joined.select(*(F.when(F.col(gone).isNull(), F.col(c)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns))
