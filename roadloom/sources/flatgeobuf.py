"""FlatGeobuf, the public binary format: flatbuffer tables behind a magic number, without an index."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from roadloom.plans.network import NetworkError, RoadNetwork
from roadloom.schema import SEGMENTS

# Fixed values of the format.
MAGIC = bytes([0x66, 0x67, 0x62, 0x03, 0x66, 0x67, 0x62, 0x01])
LINE_STRING = 2
KINDS = {2: "b", 1: "B", 0: "b", 3: "h", 4: "H", 5: "i", 6: "I", 7: "q", 8: "Q", 9: "f", 10: "d"}
LONG, DOUBLE, TEXT = 7, 10, 11

_COLUMNS = (("segment_id", LONG), ("source", LONG), ("target", LONG), ("length_m", DOUBLE), ("x0", DOUBLE), ("y0", DOUBLE), ("x1", DOUBLE), ("y1", DOUBLE), ("source_dataset", TEXT), ("cleaning_profile", TEXT), ("original_feature_id", TEXT), ("component_id", LONG))


class _Table:
    """Reads one flatbuffer table in place."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.layout = at - struct.unpack_from("<i", data, at)[0]

    @staticmethod
    def root(data: bytes) -> _Table:
        return _Table(data, struct.unpack_from("<I", data, 0)[0])

    def _place(self, slot: int) -> int | None:
        size = struct.unpack_from("<H", self.data, self.layout)[0]
        entry = 4 + 2 * slot
        offset = struct.unpack_from("<H", self.data, self.layout + entry)[0] if entry < size else 0
        return self.at + offset if offset else None

    def scalar(self, slot: int, kind: str, default):
        at = self._place(slot)
        return default if at is None else struct.unpack_from("<" + kind, self.data, at)[0]

    def _follow(self, slot: int) -> int | None:
        at = self._place(slot)
        return None if at is None else at + struct.unpack_from("<I", self.data, at)[0]

    def vector(self, slot: int, kind: str) -> tuple:
        at = self._follow(slot)
        return () if at is None else struct.unpack_from(f"<{struct.unpack_from('<I', self.data, at)[0]}{kind}", self.data, at + 4)

    def blob(self, slot: int) -> bytes:
        at = self._follow(slot)
        return b"" if at is None else self.data[at + 4 : at + 4 + struct.unpack_from("<I", self.data, at)[0]]

    def table(self, slot: int) -> _Table | None:
        at = self._follow(slot)
        return None if at is None else _Table(self.data, at)

    def tables(self, slot: int) -> Iterator[_Table]:
        at = self._follow(slot)
        for i in range(0 if at is None else struct.unpack_from("<I", self.data, at)[0]):
            entry = at + 4 + 4 * i
            yield _Table(self.data, entry + struct.unpack_from("<I", self.data, entry)[0])


def _table(slots: list[tuple[str, object] | None]) -> bytearray:
    """A table of (kind, value) slots: a struct code with a number, or ``ref`` with bytes that begin at their own target; placed at an 8-byte boundary.

    The result starts with the layout; its table begins at ``len(layout)`` rounded up to 8.
    """
    layout_size = 4 + 2 * len(slots)
    start = -(-layout_size // 8) * 8
    inline, offsets = 4, []
    for slot in slots:
        if slot is None:
            offsets.append(0)
            continue
        width = 4 if slot[0] == "ref" else struct.calcsize("<" + slot[0])
        inline = -(-inline // width) * width
        offsets.append(inline)
        inline += width
    out = bytearray(start + inline)
    struct.pack_into(f"<HH{len(slots)}H", out, 0, layout_size, inline, *offsets)
    struct.pack_into("<i", out, start, start)
    for slot, offset in zip(slots, offsets, strict=True):
        if slot is None:
            continue
        kind, value = slot
        if kind != "ref":
            struct.pack_into("<" + kind, out, start + offset, value)
        else:
            body, into = value
            out += bytes(-len(out) % 8)
            # A vector's numbers follow its count: shift so that they stand at a multiple of 8.
            struct.pack_into("<I", out, start + offset, len(out) + into - (start + offset))
            out += body
    return out


def _start(slots: list) -> int:
    return -(-(4 + 2 * len(slots)) // 8) * 8


def _vector(kind: str, values) -> tuple[str, tuple[bytes, int]]:
    return "ref", (bytes(4) + struct.pack(f"<I{len(values)}{kind}", len(values), *values), 4)


def _text(value: str) -> tuple[str, tuple[bytes, int]]:
    data = value.encode()
    return "ref", (struct.pack("<I", len(data)) + data + b"\0", 0)


def _blob(value: bytes) -> tuple[str, tuple[bytes, int]]:
    return "ref", (struct.pack("<I", len(value)) + value, 0)


def _child(slots: list) -> tuple[str, tuple[bytes, int]]:
    return "ref", (bytes(_table(slots)), _start(slots))


def _children(tables: list[list]) -> tuple[str, tuple[bytes, int]]:
    body = bytearray(struct.pack("<I", len(tables)) + bytes(4 * len(tables)))
    for i, slots in enumerate(tables):
        body += bytes(-len(body) % 8)
        struct.pack_into("<I", body, 4 + 4 * i, len(body) + _start(slots) - (4 + 4 * i))
        body += _table(slots)
    return "ref", (bytes(body), 0)


def _message(slots: list) -> bytes:
    """A size-prefixed buffer of one table."""
    body = bytes(8) + bytes(_table(slots))
    body = struct.pack("<I", 8 + _start(slots)) + body[4:]
    body += bytes(-len(body) % 8)
    return struct.pack("<I", len(body)) + body


def encode(rows: list[dict], crs: int = 4326) -> bytes:
    """A file of segments, features in the given order."""
    columns = _children([[_text(name), ("B", kind)] for name, kind in _COLUMNS])
    header = [_text("segments"), None, ("B", LINE_STRING), None, None, None, None, columns, ("Q", len(rows)), ("H", 0), _child([None, ("i", crs)])]
    out = [MAGIC, _message(header)]
    for row in rows:
        properties = bytearray()
        for i, (name, kind) in enumerate(_COLUMNS):
            value = row.get(name)
            if value is None:
                continue
            properties += struct.pack("<H", i)
            if kind == TEXT:
                data = str(value).encode()
                properties += struct.pack("<I", len(data)) + data
            else:
                properties += struct.pack("<" + KINDS[kind], value)
        flat = [v for p in row["geometry"] for v in (p[0], p[1])]
        out.append(_message([_child([None, _vector("d", flat), None, None, None, None, ("B", LINE_STRING)]), _blob(bytes(properties))]))
    return b"".join(out)


def decode(data: bytes) -> list[dict]:
    """Features in order: their line and properties. An index, if there is one, is skipped; other geometries are refused."""
    if data[:3] != MAGIC[:3]:
        raise NetworkError("Not a FlatGeobuf file.")
    size = struct.unpack_from("<I", data, 8)[0]
    header = _Table.root(data[12 : 12 + size])
    columns = [(c.blob(0).decode(), c.scalar(1, "B", 0)) for c in header.tables(7)]
    kind, count, node_size = header.scalar(2, "B", 0), header.scalar(8, "Q", 0), header.scalar(9, "H", 16)
    at = 12 + size
    if node_size and count:
        nodes, level = count, count
        while level > 1:
            level = -(-level // node_size)
            nodes += level
        at += nodes * 40
    out = []
    while at + 4 <= len(data):
        size = struct.unpack_from("<I", data, at)[0]
        feature = _Table.root(data[at + 4 : at + 4 + size])
        at += 4 + size
        geometry = feature.table(0)
        if geometry is None or (geometry.scalar(6, "B", 0) or kind) != LINE_STRING:
            raise NetworkError("Segments must be LineString features.")
        xy = geometry.vector(1, "d")
        row = {"geometry": list(zip(xy[::2], xy[1::2], strict=True))}
        held, place = feature.blob(1), 0
        own = [(c.blob(0).decode(), c.scalar(1, "B", 0)) for c in feature.tables(2)] or columns
        while place + 2 <= len(held):
            name, column = own[struct.unpack_from("<H", held, place)[0]]
            place += 2
            if column in KINDS:
                row[name] = struct.unpack_from("<" + KINDS[column], held, place)[0]
                place += struct.calcsize("<" + KINDS[column])
            else:
                n = struct.unpack_from("<I", held, place)[0]
                row[name] = held[place + 4 : place + 4 + n].decode()
                place += 4 + n
        out.append(row)
    return out


def read_flatgeobuf(spark: SparkSession, path: str) -> RoadNetwork:
    """The network of one file, which an executor reads and decodes."""
    return network_of(spark.read.format("binaryFile").load(path))


def network_of(contents: DataFrame) -> RoadNetwork:
    """The network of one file's bytes in a column ``content``; one task decodes them, since the format has no index of its rows without a walk."""
    import pyarrow as pa

    names = SEGMENTS.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                columns: dict[str, list] = {n: [] for n in names}
                for i, row in enumerate(decode(content)):
                    for need in ("source", "target", "length_m"):
                        if not isinstance(row.get(need), int | float):
                            raise NetworkError(f"Feature property {need} must be numeric.")
                    row = {**row, "segment_index": i, "segment_id": row.get("segment_id", i), "geometry": [{"x": x, "y": y} for x, y in row["geometry"]]}
                    for n in names:
                        value = row.get(n)
                        columns[n].append(int(value) if value is not None and n in ("segment_id", "source", "target", "component_id") else value)
                line = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
                kind = lambda f: line if f.name == "geometry" else {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], kind(f)) for f in SEGMENTS.fields], names)

    rows = contents.select("content").mapInArrow(scan, SEGMENTS)
    return RoadNetwork(rows).validate()


def to_flatgeobuf(network: RoadNetwork, crs: int = 4326) -> bytes:
    """One file as bytes, for networks that fit the driver."""
    rows = []
    for r in network.segments.orderBy("segment_index").toLocalIterator():
        row = {n: r[n] for n, _ in _COLUMNS}
        rows.append(row | {"geometry": [(p["x"], p["y"]) for p in r["geometry"]]})
    return encode(rows, crs)
