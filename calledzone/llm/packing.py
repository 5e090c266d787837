"""Token ids as packed binary matrices.

Texts are encoded and split losslessly into pieces of LENGTH tokens at most. Full pieces are rows as they are and never
shuffled. The rest are dealt at random into groups of bounded size, and each group is packed best-fit
decreasing: the longest piece first, each into the row with the least room that still takes it. That row is found by
a search in a segment tree over capacities.

An output row is a matrix: `ids` (little-endian uint32, LENGTH a row, padded with PAD), `positions` (uint16, starting at
zero in every segment and in the padding), and for its segments in order `seg_lengths` (cumulative lengths, counted from each
row's start), `seg_rows`, `doc_ids`, `pieces`.

Defined cases: null text counts as empty; an empty text is a piece with the end id alone. Null ids are kept as null.
Repeated rows are packed each. An empty table gives no matrices. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep, map_arrow, slices, two_columns
from .sentencepiece_bpe import ENCODED_BYTES, Encoder, Model, read_model

LENGTH, PAD, MATRIX_ROWS, GROUP = 2048, 0, 64, 4096
COUNT = np.arange(LENGTH, dtype="<u2")
SCHEMA = ("n_rows int, length int, n_tokens long, ids binary, positions binary, "
          "seg_lengths array<int>, seg_rows array<int>, doc_ids array<long>, pieces array<int>")


class Capacities:
    """Segment tree over the room left in rows: finds the least room of `need` or more."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, change: int) -> None:
        node = self.size + room
        while node:
            self.counts[node] += change
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the fullest row that takes `need`, removed from the tree."""
        node = self.size + need
        if not self.counts[node]:
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Rows of indices into `sizes`; the longest first, ties in the given order."""
    rows: list[list[int]] = []
    tree = Capacities(length)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            found = length, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            tree.put(room - sizes[i], row)
    return rows


def _matrices(rows: list[list[tuple]]) -> Iterator[dict]:
    """Rows of (doc_id, piece, ids) segments as matrices."""
    for start in range(0, len(rows), MATRIX_ROWS):
        part = rows[start:start + MATRIX_ROWS]
        ids = np.full((len(part), LENGTH), PAD, "<u4")
        places = np.zeros((len(part), LENGTH), "<u2")
        out = {"n_rows": len(part), "length": LENGTH, "n_tokens": 0, "seg_lengths": [], "seg_rows": [], "doc_ids": [], "pieces": []}
        for r, row in enumerate(part):
            at = 0
            for doc_id, piece, tokens in row:
                end = at + len(tokens)
                ids[r, at:end] = tokens
                places[r, at:end] = COUNT[:len(tokens)]
                for name, value in (("seg_lengths", end), ("seg_rows", r), ("doc_ids", doc_id), ("pieces", piece)):
                    out[name].append(value)
                at = end
            places[r, at:] = COUNT[:LENGTH - at]
            out["n_tokens"] += at
        yield out | {"ids": ids.tobytes(), "positions": places.tobytes()}


_MATRIX = pa.schema([
    ("n_rows", pa.int32()), ("length", pa.int32()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("positions", pa.binary()),
    ("seg_lengths", pa.list_(pa.int32())), ("seg_rows", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())),
    ("pieces", pa.list_(pa.int32()))])


def stored_ids(model: Model) -> str:
    """Type of an id on the way to its group: two bytes where the vocabulary allows it."""
    return "<u2" if model.vocabulary <= 1 << 16 else "<u4"


def _pieces(model: Model):
    """Pieces that are not full as rows of their own; full ones as matrices, both in one table."""
    stored = stored_ids(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = Encoder(model), 0
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("place", pa.int64()), ("tokens", pa.binary()),
                            ("matrix", pa.struct(list(_MATRIX)))])
        for batch in slices(batches, max_bytes=ENCODED_BYTES):
            full, owners, numbers, tokens = [], [], [], []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                ids = np.append(ids, model.end_id)
                whole = len(ids) // LENGTH
                for piece in range(whole):
                    full.append([(doc_id, piece, ids[piece * LENGTH:(piece + 1) * LENGTH])])
                if whole * LENGTH < len(ids):
                    owners.append(doc_id)
                    numbers.append(whole)
                    tokens.append(ids[whole * LENGTH:].astype(stored).tobytes())
            for matrix in _matrices(full):
                yield pa.RecordBatch.from_pylist([{"matrix": matrix}], schema=schema)
            for start in range(0, len(owners), 512):
                part = slice(start, start + 512)
                count = len(owners[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owners[part], pa.int64()), pa.array(numbers[part], pa.int32()),
                     pa.array(range(number, number + count), pa.int64()), pa.array(tokens[part], pa.binary()),
                     pa.nulls(count, schema.field("matrix").type)], schema=schema)
                number += count
    return run


def _pack(stored: str):
    """Matrices of the pieces of a group."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("piece").to_pylist(), table.column("tokens").to_pylist()),
                      key=lambda row: (row[0] is None, row[0] or 0, row[1]))
        segments = [(doc_id, piece, np.frombuffer(tokens, stored)) for doc_id, piece, tokens in rows]
        packed = best_fit_decreasing([len(s[2]) for s in segments])
        return pa.Table.from_pylist(list(_matrices([[segments[i] for i in row] for row in packed])), schema=_MATRIX)
    return run


def pack_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matrices of all documents' token ids."""
    groups = max(1, -(-docs.count() // GROUP))
    matrix = ", ".join(field.replace(" ", ": ", 1) for field in SCHEMA.split(", "))
    model = read_model(model_path)
    pieces = keep(map_arrow(two_columns(docs, id_col, text_col), _pieces(model),
                            f"doc_id long, piece int, place long, tokens binary, matrix struct<{matrix}>"), "pieces")
    whole = pieces.filter("matrix is not null").select("matrix.*")
    rest = pieces.filter("matrix is null").select("doc_id", "piece", "tokens",
        F.pmod(F.xxhash64("doc_id", "piece", "place"), F.lit(groups)).alias("group"))
    return whole.unionByName(rest.groupBy("group").applyInArrow(_pack(stored_ids(model)), SCHEMA))


def unpack(matrices: DataFrame) -> DataFrame:
    """(doc_id, ids) of each document whose pieces all lie in `matrices`; ids that occur once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<u4").reshape(row["n_rows"], row["length"])
                starts = [0 if k == 0 or row["seg_rows"][k] != row["seg_rows"][k - 1] else row["seg_lengths"][k - 1]
                          for k in range(len(row["seg_rows"]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["pieces"], pa.int32()),
                     pa.array([ids[r, a:b].astype(np.int32) for r, a, b in zip(row["seg_rows"], starts, row["seg_lengths"])],
                              pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])

    pieces = map_arrow(matrices, run, "doc_id long, piece int, ids array<int>")
    return pieces.groupBy("doc_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda p: p["ids"])).alias("ids"))
