"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash of GRAM bytes runs over every text. In each window of LENGTH bytes the least hash is the trigger; neighbouring
windows with the same trigger make a phrase: the text from the first of them to the end of the last. Triggers
depend on the bytes of the window alone, so equal windows have their trigger, and their place in
relation to it, in common, wherever they stand. The parse of a text is its row of phrases; the dictionary holds each phrase once.

Whether a window occurs elsewhere is read from the parse and the dictionary together:

1. Phrases none of whose halves around the trigger occurs twice hold no repeated window and are left out, by a
   Bloom filter inside the scan.
2. A phrase that stands in the parse twice or more repeats all its windows; only its entry in the dictionary goes on.
3. The same is done for blocks of neighbouring windows of dictionary entries: blocks whose common bytes are met once are
   left out, blocks that are equal as a whole are repeated, and one of each goes on.
4. Suffixes of what is left (windows at one place relative to the trigger) are ranked by their first LENGTH bytes. Suffixes of
   equal rank are repeated.

The order among different suffixes does not matter for removal, so ranks are 128-bit fingerprints instead of positions in a
lexicographic suffix array, which would put all entries that share a trigger into one task; counts of
fingerprints are combined before the shuffle and have no hot key. Two fingerprints from the same hash family never decide
alone: both halves must agree.

Defined cases: null text counts as empty; texts shorter than LENGTH bytes lose nothing; empty texts are
returned with zeros. A repeated document repeats all its windows. Rows with a null id are matched and cut like others, under
a private negative key made of their text (63 bits; an id below zero may be the same by chance), and come back with a null id;
an id must name one text. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .scratch import keep, map_arrow, slices, two_columns
from .words import mix

LENGTH, GRAM, BLOCK = 200, 16, 16
REACH = LENGTH - GRAM
HALF = REACH // 2
FILTER_BITS = 1 << 27
SEGMENT_BYTES = 1 << 20

_RANDOM = np.random.default_rng(99)
_BYTES = [_RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) for _ in range(2)]
_BASES = [int(b) * 2 + 1 for b in _RANDOM.integers(1 << 60, 1 << 62, 2)]


class Hashes:
    """Hashes of any stretches of a buffer, by differences of prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray, family: int):
        base, inverse = _BASES[family], pow(_BASES[family], -1, 1 << 64)
        self.family = family
        self.powers = _powers(base, len(data) + 1)
        self.inverses = _powers(inverse, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[family][data] * self.powers[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverses[starts]
        return mix(raw + (ends - starts).astype(np.uint64))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by running minima within blocks of that width from both sides."""
    count = len(values) - width + 1
    pad = -len(values) % width
    table = np.append(values, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))).reshape(-1, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:count], left[width - 1:width - 1 + count])


def phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Phrases of the texts in a buffer: owner, first and last window, trigger; and the buffer's hashes."""
    first_family = Hashes(data, 0)
    count = len(data) - LENGTH + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, first_family
    places = np.arange(len(data) - GRAM + 1)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    grams = first_family.of(places, places + GRAM)
    keyed = (grams >> bits << bits) | places.astype(np.uint64)
    trigger = (_window_minimum(keyed, LENGTH - GRAM + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(count), side="right")
    owner = np.minimum(owner, len(ends) - 1)
    inside = np.arange(count) + LENGTH <= ends[owner]
    windows = np.flatnonzero(inside)
    trigger, owner = trigger[windows], owner[windows]
    if not len(windows):
        return windows, windows, windows, windows, first_family
    new = np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(windows)) - 1
    return owner[begin], windows[begin], windows[last], trigger[begin], first_family


def _buffers(batches: Iterator[pa.RecordBatch]):
    """(ids, bytes, starts, ends) of bounded slices."""
    for batch in slices(batches, max_bytes=SEGMENT_BYTES):
        raw = [text.encode() for text in batch.column("text").to_pylist()]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        yield batch, np.frombuffer(b"".join(raw), np.uint8), ends - np.fromiter(map(len, raw), np.int64, len(raw)), ends


def _halves(first, last, trigger, hashes: Hashes):
    """Hashes of the half phrases: each window holds the left half before its trigger or the right one behind it."""
    has_left, has_right = first <= trigger - HALF, last > trigger - HALF
    left, right = trigger[has_left], trigger[has_right]
    return has_left, hashes.of(left - HALF, left + GRAM), has_right, hashes.of(right, right + GRAM + HALF)


def _half_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, starts, ends in _buffers(batches):
        _, first, last, trigger, hashes = phrases(data, starts, ends)
        _, left, _, right = _halves(first, last, trigger, hashes)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([left, right ^ np.uint64(1)]).view(np.int64))], names=["h"])


def _known(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _block_hashes(first, last, trigger, hashes: Hashes):
    """For each block of places of each phrase: phrase, hash of what its windows have in common, hash of the whole."""
    low, high = (trigger - last) // BLOCK, (trigger - first) // BLOCK
    number = high - low + 1
    phrase = np.repeat(np.arange(len(first)), number)
    block = np.arange(len(phrase)) - np.repeat(np.cumsum(number) - number, number) + low[phrase]
    start = trigger[phrase] - BLOCK * block
    common = hashes.of(start, start - (BLOCK - 1) + LENGTH) ^ block.astype(np.uint64)
    begin = np.maximum(first[phrase], start - (BLOCK - 1))
    end = np.minimum(last[phrase], start)
    shape = mix(((trigger[phrase] - begin) * LENGTH + (trigger[phrase] - end)).astype(np.uint64))
    return phrase, common, hashes.of(begin, end + LENGTH) ^ shape


def _parse(bits):
    """Phrases that may repeat: doc_id, first and last window, trigger, fingerprint, hashes of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(bits.value, np.uint8)
        for batch, data, starts, ends in _buffers(batches):
            owner, first, last, trigger, hashes = phrases(data, starts, ends)
            has_left, left, has_right, right = _halves(first, last, trigger, hashes)
            left_known, right_known = np.zeros(len(first), bool), np.zeros(len(first), bool)
            left_known[has_left] = _known(bitmap, left)
            right_known[has_right] = _known(bitmap, right ^ np.uint64(1))
            first = np.where(left_known, first, np.maximum(first, trigger - HALF + 1))
            last = np.where(right_known, last, np.minimum(last, trigger - HALF))
            stay = (left_known | right_known) & (first <= last)
            owner, first, last, trigger = owner[stay], first[stay], last[stay], trigger[stay]
            if not len(first):
                continue
            second = Hashes(data, 1)
            phrase, common, whole = _block_hashes(first, last, trigger, hashes)
            offsets = np.searchsorted(phrase, np.arange(len(first) + 1)).astype(np.int32)
            blocks = pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in (common, whole)], names=["h", "g"])
            base = starts[owner]
            shape = ((trigger - first) * LENGTH + (trigger - last)).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array((first - base).astype(np.int32)),
                 pa.array((last - base).astype(np.int32)), pa.array((trigger - base).astype(np.int32)),
                 pa.array((hashes.of(first, last + LENGTH) ^ mix(shape)).view(np.int64)), pa.array(second.of(first, last + LENGTH).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), blocks)],
                names=["doc_id", "first", "last", "trigger", "f1", "f2", "blocks"])
    return run


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the given dictionary entries: doc_id, start, whether the entry stands once, fingerprints."""
    for batch in slices(batches, max_bytes=SEGMENT_BYTES):
        for row in range(batch.num_rows):
            raw = np.frombuffer(batch.column("text")[row].as_py().encode(), np.uint8)
            entries = batch.column("entries")[row].values
            first, last, trigger, block = (entries.field(n).to_numpy() for n in ("first", "last", "trigger", "block"))
            once = entries.field("once").to_numpy(zero_copy_only=False)
            low = np.maximum(first, trigger - BLOCK * block - (BLOCK - 1)).astype(np.int64)
            high = np.minimum(last, trigger - BLOCK * block).astype(np.int64)
            number = np.maximum(high - low + 1, 0)
            entry = np.repeat(np.arange(len(first)), number)
            start = np.arange(len(entry)) - np.repeat(np.cumsum(number) - number, number) + low[entry]
            place = (trigger[entry] - start).astype(np.uint64)
            families = [Hashes(raw, family).of(start, start + LENGTH) for family in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("doc_id")[row].as_py()] * len(start), pa.int64()), pa.array(start.astype(np.int32)),
                 pa.array(once[entry]), pa.array((families[0] ^ mix(place)).view(np.int64)), pa.array(families[1].view(np.int64))],
                names=["doc_id", "start", "once", "f1", "f2"])


def _bitmap(hashes: DataFrame, bits: int) -> bytes:
    """Bits of the slots met twice; the driver gets FILTER_BITS / 8 bytes at most."""
    out = np.zeros(bits // 8, np.uint8)
    for row in bloom.repeated(hashes, bits, number=1).toLocalIterator():
        start = row["block"] * bloom.BLOCK_BITS // 8
        out[start:start + bloom.BLOCK_BITS // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.tobytes()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key): the id, or a negative number made of the text where there is none."""
    private = F.xxhash64("text").bitwiseOR(F.lit(-1 << 63))
    return two_columns(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", private))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop): stretches of windows that occur elsewhere, in bytes; they may overlap. Rows with a null
    id go by their private key."""
    texts = _keyed(docs, id_col, text_col).select(F.col("key").alias("doc_id"), "text")
    spark = docs.sparkSession
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = bloom.size_for(size // HALF, per_row=12, max_bits=FILTER_BITS)
    filter_ = spark.sparkContext.broadcast(_bitmap(map_arrow(texts, _half_hashes, "h long"), bits))
    parse = keep(map_arrow(
        texts, _parse(filter_),
        "doc_id long, first int, last int, trigger int, f1 long, f2 long, blocks array<struct<h: long, g: long>>"), "parse")
    entry = F.struct("doc_id", "first", "last", "trigger", "blocks")
    dictionary = keep(parse.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min(entry).alias("entry")), "dictionary")
    repeated = dictionary.filter("n > 1").select("f1", "f2")
    whole = parse.join(keep(repeated, "repeated"), ["f1", "f2"], "left_semi").select(
        "doc_id", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop"))
    low = F.floor((F.col("entry.trigger") - F.col("entry.last")) / BLOCK)
    each = dictionary.select(
        (F.col("n") == 1).alias("once"), "entry.doc_id", "entry.first", "entry.last", "entry.trigger", low.alias("low"),
        F.posexplode("entry.blocks").alias("at", "b"))
    each = each.select("once", "doc_id", "first", "last", "trigger", (F.col("low") + F.col("at")).cast("int").alias("block"), "b.h", "b.g")
    # Common bytes met once have no equal; those met in repeated phrases only are covered already.
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.bool_or("once").alias("any_once"))
    shared = keep(each.join(keep(counts.filter("n > 1 and any_once").select("h"), "common"), "h", "left_semi"), "shared")
    place = F.struct("doc_id", "first", "last", "trigger", "block", "once")
    kinds = keep(shared.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("entry")), "kinds")
    begin = F.greatest(F.col("first"), F.col("trigger") - BLOCK * F.col("block") - (BLOCK - 1))
    stop = F.least(F.col("last"), F.col("trigger") - BLOCK * F.col("block")) + LENGTH
    blocks = shared.filter("once").join(keep(kinds.filter("n > 1").select("h", "g"), "equal"), ["h", "g"], "left_semi").select(
        "doc_id", begin.cast("int").alias("start"), stop.cast("int").alias("stop"))
    single = (F.col("n") == 1) & F.col("entry.once")
    open_ = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.bool_or(single).alias("any_single"))
    entries = kinds.select("h", F.struct("entry.doc_id", "entry.first", "entry.last", "entry.trigger", "entry.block",
                                         single.alias("once")).alias("entry")).join(
        keep(open_.filter("n > 1 and any_single").select("h"), "open"), "h", "left_semi").select("entry.doc_id", "entry")
    by_text = keep(entries.groupBy("doc_id").agg(F.collect_list("entry").alias("entries")), "entries")
    wanted = by_text.select("doc_id")
    met = bloom.within(texts, "doc_id", wanted, by_text.count()).join(by_text, "doc_id")
    suffixes = keep(map_arrow(met.select("doc_id", "text", "entries"), _suffixes,
                              "doc_id long, start int, once boolean, f1 long, f2 long"), "suffixes")
    ranks = keep(suffixes.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.bool_or("once").alias("any_once"))
                 .filter("n > 1 and any_once").select("f1", "f2"), "ranks")
    windows = suffixes.filter("once").join(ranks, ["f1", "f2"], "left_semi").select(
        "doc_id", "start", (F.col("start") + LENGTH).alias("stop"))
    return whole.unionByName(blocks).unionByName(windows)


def _merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans; touching ones are one run."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order].astype(np.int64), np.maximum.accumulate(stops[order].astype(np.int64))
    new = np.concatenate([[True], starts[1:] > stops[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(starts)) - 1
    return starts[new], stops[last]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(*[batch.column(n) for n in ("doc_id", "text", "spans")]):
            raw = np.frombuffer(text.as_py().encode(), np.uint8)
            starts, stops = _merged(spans.values.field("start").to_numpy(), spans.values.field("stop").to_numpy())
            stay = np.ones(len(raw), bool)
            for start, stop in zip(starts, stops):
                stay[start:stop] = False
            left = raw[stay].tobytes()
            out.append((doc_id.as_py(), len(raw), len(raw) - len(left), len(starts), left))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_bytes."""
    texts = _keyed(docs, id_col, text_col)
    spans = keep(find_spans(docs, id_col, text_col).groupBy(F.col("doc_id").alias("key")).agg(
        F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    ids, number = spans.select("key"), spans.count()
    met = bloom.within(texts, "key", ids, number).join(spans, "key")
    cut = map_arrow(met.select("doc_id", "text", "spans"), _cut,
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary")
    plain = bloom.without(texts, "key", ids, number).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept_bytes"))
    return plain.unionByName(cut)
