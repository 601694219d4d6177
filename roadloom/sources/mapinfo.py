"""MapInfo interchange text: MIF lines with MID attributes; extents, normalization and unlink masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.plans.network import NetworkError

_NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_LINE = rf"(?i)^\s*LINE\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}"


def text_lines(texts: DataFrame) -> DataFrame:
    """(n, line) of the lines of whole texts in a column ``value``, blank ones dropped."""
    return texts.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where(F.trim("line") != "")


def mid_cells(line: Column) -> Column:
    """Cells of a line: commas inside quotes don't split, quotes are dropped, cells are trimmed."""
    cells = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(cells, lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))


def parse_mid(texts: DataFrame) -> DataFrame:
    """(row, cells, numbers): cells as text, and as numbers where they are."""
    lines = text_lines(texts)
    row = F.row_number().over(_whole("n")) - 1
    cells = lines.select(row.cast("bigint").alias("row"), mid_cells(F.col("line")).alias("cells"))
    return cells.withColumn("numbers", F.transform("cells", lambda c: F.when(c == "", 0.0).otherwise(c.try_cast("double"))))


def _whole(order: str):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(order)  # one interchange file is one text


def mif_columns(texts: DataFrame) -> list[str]:
    """Attribute names of the header."""
    lines = [r["line"].strip() for r in text_lines(texts).where(F.col("n") < 1000).orderBy("n").toLocalIterator()]
    for i, line in enumerate(lines):
        words = line.split()
        if len(words) >= 2 and words[0].lower() == "columns":
            return [x.split()[0] for x in lines[i + 1 : i + 1 + int(words[1])]]
        if line.lower() == "data":
            break
    return []


def parse_mif(mif: DataFrame, mid: DataFrame | None = None) -> DataFrame:
    """(row, x0, y0, x1, y1, properties) of the LINE records after ``Data``; other objects are skipped and take no MID row."""
    names = mif_columns(mif)
    lines = text_lines(mif)
    start = lines.where(F.lower(F.trim("line")) == "data").agg(F.min("n")).first()[0]
    found = lines.where(F.col("n") > (start if start is not None else -1)).where(F.col("line").rlike(_LINE))
    numbers = [F.regexp_extract("line", _LINE, i).cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"), 1)]
    found = found.select((F.row_number().over(_whole("n")) - 1).cast("bigint").alias("row"), *numbers)
    none = F.lit(None).cast("string")
    if mid is None:
        return found.withColumn("properties", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[none] * len(names))) if names else F.create_map().cast("map<string,string>"))
    joined = found.join(parse_mid(mid), "row", "left")
    values = F.array(*(F.get("cells", F.lit(i)) for i in range(len(names))))
    return joined.select("row", "x0", "y0", "x1", "y1", F.map_from_arrays(F.array(*map(F.lit, names)), values).alias("properties"))


def features_of(lines: DataFrame) -> DataFrame:
    """``schema.FEATURES`` of parsed lines; the id is the ordinal."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return lines.select(F.col("row").alias("feature_index"), F.col("row").cast("string").alias("id"), F.array(F.array(point("x0", "y0"), point("x1", "y1"))).alias("parts"), "properties")


def extent(features: DataFrame) -> DataFrame:
    """One row min_x, min_y, max_x, max_y over all coordinates; infinite where there are none."""
    p = features.select(F.explode(F.flatten("parts")).alias("p"))
    inf = float("inf")
    return p.agg(*(F.coalesce(f(F.col(f"p.{c}")), F.lit(d)).alias(f"{n}_{c}") for n, f, d in (("min", F.min, inf), ("max", F.max, -inf)) for c in "xy"))


@dataclass(frozen=True)
class LocalNormalizer:
    """Moves the centre of an extent to 0 and scales its larger side to 1."""

    centre_x: float
    centre_y: float
    scale: float

    @staticmethod
    def of(features: DataFrame) -> LocalNormalizer:
        e = extent(features).first()
        side = max(e["max_x"] - e["min_x"], e["max_y"] - e["min_y"])
        if not side > 0:
            raise NetworkError("Cannot normalize an empty extent.")
        return LocalNormalizer((e["min_x"] + e["max_x"]) / 2, (e["min_y"] + e["max_y"]) / 2, 1 / side)

    def apply(self, features: DataFrame) -> DataFrame:
        def moved(p):
            return F.struct(((p["x"] - self.centre_x) * self.scale).alias("x"), ((p["y"] - self.centre_y) * self.scale).alias("y"))

        return features.withColumn("parts", F.transform("parts", lambda line: F.transform(line, moved)))


def unlink_masks(lines: DataFrame, padding: float = 2.0) -> DataFrame:
    """(cx, cy, radius) circles over the lines of ``parse_mif``: around the middle, half the length and the padding."""
    half = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2
    return lines.select(((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.greatest(F.lit(float(padding)), half + padding).alias("radius"))
