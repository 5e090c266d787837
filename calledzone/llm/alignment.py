"""Alignment of two tokenizers over the same bytes, by pointer jumping.

Both token sequences cover the bytes of a text with a space in front, so a token overlaps the tokens of the other
side that share a byte with it. Every token points to its farthest-right overlapping token, the last one of a
component to itself. Successors are doubled (`succ = succ[succ]`) until nothing moves; each token then
names its component's terminal token, which labels the group. A batch of texts is one byte line to the arrays: texts end
where both sides end, so no group crosses them.

Links are the overlapping pairs of token occurrences. How many documents hold an id pair is counted in steps:
tasks count the distinct pairs of blocks of documents of bounded size, Spark adds the blocks up, and hands each block the
counts of its own pairs back. A pair that stands in every document thus moves once a block, and no table of all
pairs is broadcast or collected.

The byte side (A) is read as ranks by tiktoken, which gives the ids of the same vocabulary's JSON file; the
piece side (B) is encoded by sentencepiece, without special tokens on either side.

Defined cases: null and empty texts have no tokens, nor have texts whose joined token bytes differ from the space and the text
on either side (a text that holds U+2581): zeros, and an empty digest column. Null ids are kept and count as
documents of their own; repeated rows are documents each. A long text is not cut. An empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep, map_arrow, slices, two_columns

# Text aligned at once, and text whose pairs are counted together.
SLICE_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20
ALIGNED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "steps array<int>, times array<int>, pairs array<long>, holders array<int>")
SCORED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


class ByteTokens:
    """Side A: byte-level BPE ids and the bytes each stands for."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.library = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.surfaces = [b""] * (max(ranks.values()) + 1)
        for surface, i in ranks.items():
            self.surfaces[i] = surface

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.library.encode_to_numpy(" " + text, disallowed_special=()) for text in texts]


class PieceTokens:
    """Side B: sentencepiece ids and the bytes each stands for."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.surfaces = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace("▁", " ").encode()
                         for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.library.encode(texts, num_threads=1)]


def overlap_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each token of both sides, from the byte each token ends at (both sides end at the same byte)."""
    na, nb = len(ends_a), len(ends_b)
    if not na:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    farthest_a = np.searchsorted(ends_b, ends_a, "left")
    farthest_b = np.searchsorted(ends_a, ends_b, "left")
    reaches = ends_a[farthest_b] > ends_b
    succ = np.concatenate([na + farthest_a, np.where(reaches, farthest_b, na + np.arange(nb))])
    while True:
        jumped = succ[succ]
        if np.array_equal(jumped, succ):
            break
        succ = jumped
    label = np.cumsum(~reaches) - 1
    group = label[succ - na]
    return group[:na], group[na:]


def overlapping_pairs(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all tokens that share a byte."""
    starts = np.concatenate([[0], ends_a[:-1]])
    first = np.searchsorted(ends_b, starts, "right")
    wide = np.searchsorted(ends_b, ends_a, "left") - first + 1
    in_a = np.repeat(np.arange(len(ends_a)), wide)
    before = np.repeat(np.cumsum(wide) - wide, wide)
    return in_a, np.repeat(first, wide) + np.arange(len(in_a)) - before


class Writer:
    """Group texts `a1,a2|b1;a3|b2`, from one table of number texts for each sign that may follow."""

    def __init__(self, ids: int):
        self.ids = ids
        self.table = [b"%d%s" % (i, sign) for sign in (b",", b"|", b";") for i in range(ids)]

    def digests(self, ids_a, ids_b, group_a, group_b, docs_a, docs_b, number: int) -> list[str]:
        """SHA-256 of each document's groups; a document without tokens has ''."""
        group = np.concatenate([group_a, group_b])
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order = np.argsort(group * 2 + side, kind="stable")
        group, side, ids = group[order], side[order], np.concatenate([ids_a, ids_b]).astype(np.int64)[order]
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)
        sign = np.where(last, 1 + side, 0)
        told = list(map(self.table.__getitem__, (sign * self.ids + ids).tolist()))
        ends = np.cumsum(np.bincount(docs_a, minlength=number) + np.bincount(docs_b, minlength=number)).tolist()
        out, start = [], 0
        for end in ends:
            out.append(hashlib.sha256(b"".join(told[start:end])[:-1]).hexdigest() if end > start else "")
            start = end
        return out


class Block:
    """Documents whose pairs are counted together."""

    def __init__(self):
        self.size, self.rows, self.pairs, self.times = 0, [], [], []

    def batch(self, number: int) -> pa.RecordBatch:
        """A row for each document, its pairs as steps in the block's sorted list, and one row for that list."""
        sizes = [len(p) for p in self.pairs]
        flat = np.concatenate(self.pairs) if sizes else np.zeros(0, np.int64)
        pairs, place = np.unique(flat, return_inverse=True)
        holders = np.bincount(place, minlength=len(pairs))
        steps, start = [], 0
        for size in sizes:
            steps.append(np.diff(place[start:start + size], prepend=0).astype(np.int32))
            start += size
        rows = [*self.rows, (None, None, None, None, None, None)]
        columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate([pa.int64()] * 5 + [pa.string()])]
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * len(rows), pa.int64()), *columns,
             pa.array([*steps, None], pa.list_(pa.int32())), pa.array([*self.times, None], pa.list_(pa.int32())),
             pa.array([*([None] * len(sizes)), pairs.astype(np.int64)], pa.list_(pa.int64())),
             pa.array([*([None] * len(sizes)), holders.astype(np.int32)], pa.list_(pa.int32()))],
            names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "times", "pairs", "holders"])


def _same_bytes(found: list[np.ndarray], surfaces: list[bytes], wanted: list[bytes]) -> np.ndarray:
    look = surfaces.__getitem__
    return np.array([b"".join(map(look, ids.tolist())) == want for ids, want in zip(found, wanted)], bool)


def align_texts(texts: list[str], side_a: ByteTokens, side_b: PieceTokens, widths, writer: Writer):
    """For each text: (n_a, n_b, n_groups, n_links, digest), its distinct id pairs and how often each occurs."""
    found_a, found_b = side_a.encode(texts), side_b.encode(texts)
    wanted = [b" " + text.encode() for text in texts]
    good = _same_bytes(found_a, side_a.surfaces, wanted) & _same_bytes(found_b, side_b.surfaces, wanted)
    good &= np.array([bool(text) for text in texts], bool)
    none = np.zeros(0, np.uint32)
    found_a = [ids if ok else none for ids, ok in zip(found_a, good)]
    found_b = [ids if ok else none for ids, ok in zip(found_b, good)]
    number = len(texts)
    counts_a = np.fromiter(map(len, found_a), np.int64, number)
    counts_b = np.fromiter(map(len, found_b), np.int64, number)
    ids_a, ids_b = np.concatenate(found_a), np.concatenate(found_b)
    docs_a, docs_b = np.repeat(np.arange(number), counts_a), np.repeat(np.arange(number), counts_b)
    ends_a, ends_b = np.cumsum(widths[0][ids_a]), np.cumsum(widths[1][ids_b])
    group_a, group_b = overlap_groups(ends_a, ends_b)
    last = np.append(group_b[1:] != group_b[:-1], True)[:len(group_b)]
    n_groups = np.bincount(docs_b[last], minlength=number)
    in_a, in_b = overlapping_pairs(ends_a, ends_b)
    docs = docs_a[in_a]
    n_links = np.bincount(docs, minlength=number)
    # The document in front, so that one sort keeps documents apart.
    key = (docs.astype(np.uint64) << np.uint64(32)) | (ids_a[in_a].astype(np.uint64) << np.uint64(16)) | ids_b[in_b]
    distinct, times = np.unique(key, return_counts=True)
    owner = (distinct >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(owner, np.arange(1, number))
    pairs = np.split((distinct & np.uint64(0xFFFFFFFF)).astype(np.int64), cuts)
    digests = writer.digests(ids_a, ids_b, group_a, group_b, docs_a, docs_b, number)
    rows = zip(counts_a.tolist(), counts_b.tolist(), n_groups.tolist(), n_links.tolist(), digests)
    return rows, pairs, np.split(times.astype(np.int32), cuts)


def _align(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = ByteTokens(ranks_path, pattern), PieceTokens(model_path)
        widths = [np.fromiter(map(len, side.surfaces), np.int64) for side in (side_a, side_b)]
        writer = Writer(max(map(len, widths)))
        block, number = Block(), TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            rows, pairs, times = align_texts(texts, side_a, side_b, widths, writer)
            block.rows += [(i, *row) for i, row in zip(batch.column("doc_id").to_pylist(), rows)]
            block.pairs += pairs
            block.times += times
            block.size += sum(map(len, texts))
            if block.size >= block_bytes:
                yield block.batch(number)
                block, number = Block(), number + 1
        if block.rows:
            yield block.batch(number)

    return map_arrow(docs, run, ALIGNED)


def _pair_counts(lists: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether that is the most of any pair of its A id."""
    counts = keep(lists.groupBy("pair").agg(F.sum("holders").alias("n")), "pairs")
    a_id = F.shiftright("pair", 16).alias("a")
    most = counts.groupBy(a_id).agg(F.max("n").alias("most"))
    return counts.select("*", a_id).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _score_block(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of each document of a block, from the counts of the block's pairs."""
    order = np.argsort(counts.column("place").to_numpy())
    n = counts.column("n").to_numpy()[order]
    best = counts.column("best").to_numpy(zero_copy_only=False)[order]
    n_best, count_sum = [], []
    steps, times = docs.column("steps"), docs.column("times")
    for i in range(docs.num_rows):
        place = np.cumsum(steps[i].values.to_numpy(zero_copy_only=False))
        often = times[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
        n_best.append(int(often[best[place]].sum()) if len(place) else 0)
        count_sum.append(int((often * n[place]).sum()) if len(place) else 0)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*[docs.column(c) for c in names], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()),
                     docs.column("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id",
          text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: tokens of both sides, groups, links, links whose id pair is the commonest of its A id,
    the sum of the pairs' document counts over the links, and a digest of the groups."""
    aligned = keep(_align(two_columns(docs, id_col, text_col), ranks_path, pattern, model_path, block_bytes), "aligned")
    listed = aligned.filter("pairs is not null").select(
        "block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "of")).select(
        "block", "place", F.col("of.pairs").alias("pair"), F.col("of.holders").alias("holders"))
    counts = _pair_counts(listed)
    of_blocks = listed.select("block", "place", "pair").join(counts, "pair").select(
        F.col("block").alias("of_block"), "place", "n", "best")
    rows = aligned.filter("pairs is null").drop("pairs", "holders")
    return rows.groupBy("block").cogroup(of_blocks.groupBy("of_block")).applyInArrow(_score_block, SCORED)
