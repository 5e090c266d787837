"""Benchmark decontamination with spaced seeds.

Fixed masks of `SPAN` tokens look at 8 of them and ignore the rest, so that a seed still matches where
tokens at ignored places were substituted. The ignored places are a covering design: any `SPAN - MATCHES` places are
ignored together by some mask, so that every stretch of `SPAN` aligned tokens that agree in `MATCHES` of them or more
has a seed. Seed hashes of the benchmark are joined with those of all documents; the ignored tokens, which
both sides carry along, tell in how many tokens the stretch agrees. None is missed and none is let through.

The benchmark may have any size. Document seeds that no item has are dropped inside the scan by a bitmap of
bounded size (`FILTER_BITS`), which may let others through but loses none; the rest meet the
items in a join, whose hot keys Spark splits. Items of fewer than `SPAN` tokens are matched as a whole, with
one substitution from `LOOSE` tokens on (masks that ignore a third each) and without below. Items of fewer than `LEAST`
tokens may stand in a text by chance: the rows that hold each of them are counted first, and those that a larger share than
`common` of all rows hold match nothing.

Tokens are lower-cased; ASCII and CJK punctuation and white space end them; in scripts without spaces each character is one. Defined cases: null text counts as empty and
leaks nothing; rows with a null id match nothing and are kept; items with a null id are used like others and
reported with a null id; items of the same tokens are matched once and all reported; repeated documents are reported
once; items without tokens match nothing; empty documents or an empty benchmark give no leaks. Other columns are not looked at.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .scratch import keep, map_arrow, slices, two_columns
from .words import MULTIPLIERS, WordHashes, flat_hashes, mix

SPAN, MATCHES, LOOSE, LEAST = 12, 10, 8, 5
COMMON = 0.001
# The places each mask ignores. Every pair of places is in one of them.
IGNORED = (
    (0, 1, 2, 3), (0, 4, 6, 7), (0, 5, 9, 11), (0, 8, 9, 10), (1, 2, 4, 9), (1, 5, 7, 8),
    (1, 6, 10, 11), (2, 5, 6, 8), (2, 7, 10, 11), (3, 4, 5, 10), (3, 4, 8, 11), (3, 6, 7, 9),
)
REST = 4
FILTER_BITS = 1 << 27
_TABLE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_SALT = 0x9E3779B97F4A7C15
_RESTS = [f"r{k}" for k in range(REST)]


# Thai and Lao, Tibetan, Myanmar, Khmer, kana, Han; then the punctuation used with them.
_ALONE = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_MARKS = re.compile("[\u3000-\u303f\uff00-\uff0f\uff1a-\uff20]")


def tokens_of(texts: list[str]) -> list[list[bytes]]:
    return [_spaced(text.lower()).encode().translate(_TABLE).split() for text in texts]


def _spaced(text: str) -> str:
    """`text` with spaces around each character of a script without spaces."""
    if text.isascii() or not _ALONE.search(text):
        return text
    return _ALONE.sub(r" \g<0> ", _MARKS.sub(" ", text))


def masks_of(width: int) -> tuple[tuple[int, ...], ...]:
    """Ignored places of each mask for passages of `width` tokens."""
    if width == SPAN or width < LOOSE:
        return IGNORED if width == SPAN else ((),)
    third = -(-width // 3)
    return tuple(tuple(range(k, min(k + third, width))) for k in range(0, width, third))


def seeds(flat: np.ndarray, ends: np.ndarray, counts: np.ndarray, widths: tuple[int, ...]):
    """For each mask of each width: width, ignored places, hashes by start, and which starts are inside a text."""
    owner_end = np.repeat(ends, counts)
    for width in widths:
        whole = max(len(flat) - width + 1, 0)
        inside = np.arange(whole) + width <= owner_end[:whole]
        parts = [flat[k:whole + k] * MULTIPLIERS[k] for k in range(width)]
        for number, ignored in enumerate(masks_of(width)):
            out = np.full(whole, np.uint64(_SALT * (64 * width + number) % (1 << 64)))
            for place in range(width):
                if place not in ignored:
                    out += parts[place]
            yield width, ignored, mix(out), inside


def _rests(flat: np.ndarray, spots: np.ndarray, ignored: tuple[int, ...]) -> list[pa.Array]:
    """Token hashes at the ignored places, then zeros, which agree always."""
    found = [flat[spots + place] for place in ignored] + [np.zeros(len(spots), np.uint64)] * (REST - len(ignored))
    return [pa.array(hashes.view(np.int64)) for hashes in found]


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        tokens = [b" ".join(words).decode() for words in tokens_of(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.string())], names=["doc_id", "text"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in slices(batches):
        flat, counts = flat_hashes(tokens_of(batch.column("text").to_pylist()), memo)
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        widths = tuple(sorted({min(int(c), SPAN) for c in counts if c}))
        for width, ignored, hashes, inside in seeds(flat, ends, counts, widths):
            spots = np.flatnonzero(inside & (np.minimum(counts, SPAN)[owner[:len(inside)]] == width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner[spots])), pa.array(hashes[spots].view(np.int64)),
                 pa.array(np.full(len(spots), width, np.int32)), *_rests(flat, spots, ignored)],
                names=["item_id", "h", "width", *_RESTS])


def _short_seeds(bits, widths: tuple[int, ...]):
    """Each seed of short items once a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        bitmap = np.frombuffer(bits.value, np.uint8)
        for batch in slices(batches):
            flat, counts = flat_hashes(tokens_of(batch.column("text").to_pylist()), memo)
            owner = np.repeat(np.arange(len(counts)), counts)
            for _, _, hashes, inside in seeds(flat, np.cumsum(counts), counts, widths):
                spots = _known(bitmap, hashes, np.flatnonzero(inside))
                met = np.stack([owner[spots].astype(np.uint64), hashes[spots]])
                met = np.unique(met, axis=1)[1] if len(spots) else met[1]
                yield pa.RecordBatch.from_arrays([pa.array(met.view(np.int64))], names=["h"])
    return run


def _document_seeds(bits, widths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        bitmap = np.frombuffer(bits.value, np.uint8)
        for batch in slices(batches):
            flat, counts = flat_hashes(tokens_of(batch.column("text").to_pylist()), memo)
            ends = np.cumsum(counts)
            starts = ends - counts
            owner = np.repeat(np.arange(len(counts)), counts)
            for _, ignored, hashes, inside in seeds(flat, ends, counts, widths):
                spots = _known(bitmap, hashes, np.flatnonzero(inside))
                if not len(spots):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owner[spots])), pa.array(hashes[spots].view(np.int64)),
                     pa.array(spots - starts[owner[spots]], pa.int64()), *_rests(flat, spots, ignored)],
                    names=["doc_id", "h", "doc_at", *_RESTS])
    return run


def _known(bitmap: np.ndarray, hashes: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """The spots whose hash may be in the filter: both halves of the bitmap must know it."""
    own = len(bitmap) * 4
    for half, shift in enumerate((0, 31)):
        slot = ((hashes[spots] >> np.uint64(shift)) & np.uint64(own - 1)).astype(np.int64) + half * own
        spots = spots[(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
    return spots


def _bitmap(items: DataFrame) -> bytes:
    """Bits of all seed hashes; the driver gets FILTER_BITS / 8 bytes at most."""
    bits = bloom.size_for(items.count(), per_row=64, max_bits=FILTER_BITS)
    out = np.zeros(bits // 8, np.uint8)
    blocks = bloom.members(items.select("h"), bits, number=2)
    for row in blocks.toLocalIterator():
        start = row["block"] * bloom.BLOCK_BITS // 8
        out[start:start + bloom.BLOCK_BITS // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.tobytes()


def _classes(benchmark: DataFrame, item_id_col: str, item_text_col: str) -> DataFrame:
    """(class_id, item_id, text): items by their tokens; items of the same tokens are one class."""
    tokens = map_arrow(two_columns(benchmark, item_id_col, item_text_col), _item_tokens, "doc_id long, text string")
    return keep(tokens.select(F.xxhash64("text").alias("class_id"), F.col("doc_id").alias("item_id"), "text").distinct(), "classes")


def _widths(items: DataFrame) -> tuple[int, ...]:
    return tuple(sorted(row.width for row in items.select("width").distinct().collect()))  # SPAN values at most


def _without_common(items: DataFrame, texts: DataFrame, common: float) -> DataFrame:
    """Seeds less those of items of fewer than LEAST tokens that a larger share than `common` of all rows hold."""
    short = items.filter(F.col("width") < LEAST)
    widths = _widths(short)
    if not widths:
        return items
    bits = texts.sparkSession.sparkContext.broadcast(_bitmap(short))
    # Few hashes pass the bitmap, so that they are counted before the shuffle.
    counts = map_arrow(texts, _short_seeds(bits, widths), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    most = int(common * texts.count())
    often = short.join(counts.filter(F.col("n") > most), "h").select("item_id").distinct()
    return keep(items.join(often, "item_id", "left_anti"), "rare")


def find_classes(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 common: float = COMMON) -> DataFrame:
    """A row for each document and class of items that share a passage, with column class_id in place of item_id."""
    spark = docs.sparkSession
    given = classes.groupBy("text").agg(F.min("class_id").alias("doc_id")).repartition(spark.sparkContext.defaultParallelism)
    rests = ", ".join(f"{name} long" for name in _RESTS)
    items = keep(map_arrow(given, _item_seeds, f"item_id long, h long, width int, {rests}"), "items")
    texts = two_columns(docs, id_col, text_col).filter("doc_id is not null")
    items = _without_common(items, texts, common)
    widths = _widths(items)
    bits = spark.sparkContext.broadcast(_bitmap(items))
    hits = map_arrow(texts, _document_seeds(bits, widths), f"doc_id long, h long, doc_at long, {rests}")
    met = hits.join(items.withColumnsRenamed({name: f"item_{name}" for name in _RESTS}), "h")
    agree = reduce(add, [(F.col(name) == F.col(f"item_{name}")).cast("int") for name in _RESTS])
    best = met.withColumn("lost", REST - agree)
    allowed = F.when(F.col("width") == SPAN, SPAN - MATCHES).when(F.col("width") >= LOOSE, 1).otherwise(0)
    return best.filter(F.col("lost") <= allowed).groupBy("doc_id", F.col("item_id").alias("class_id")).agg(
        F.min("doc_at").alias("first_token"), F.max(F.col("doc_at") + F.col("width")).alias("last_token"),
        F.max(F.col("width") - F.col("lost")).alias("matched"), F.count(F.lit(1)).alias("hits"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", common: float = COMMON) -> DataFrame:
    """A row for each document and item that share a passage: doc_id, item_id, first and last token of it in
    the document (last one not included), number of matched tokens in its best stretch, hits."""
    classes = _classes(benchmark, item_id_col, item_text_col)
    found = find_classes(docs, classes, id_col, text_col, common)
    return found.join(classes.select("class_id", "item_id"), "class_id").select(
        "doc_id", "item_id", "first_token", "last_token", "matched", "hits")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               common: float = COMMON) -> DataFrame:
    """`docs` less the documents that hold a passage of the benchmark, with all its columns."""
    found = find_classes(docs, _classes(benchmark, "item_id", "text"), id_col, text_col, common)
    lost = keep(found.select("doc_id").distinct(), "lost")
    return bloom.without(docs, id_col, lost, lost.count())
