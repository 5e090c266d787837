"""Exact Jaccard join on word n-grams, by partitioning the universe of shingles.

Sets of a size band, and those just below it that may reach into it, are cut by one hash into m segments. Two linked
sets differ in at most H = m - 1 shingles, so by the pigeonhole principle some segment is equal in both. The
first few segments of a band are also indexed with each one of their shingles left out: an equal segment spends one unit of
the difference, a segment within one deletion two. Those extra units let each set give up as many of its costliest
keys (those that most sets share) and still be sure to meet every partner. Keys are 64-bit sums of shingle
hashes; a chance meeting costs a comparison and no more.

1. Equal sets are one class; the smallest id stands for it. Classes write keys; keys met once are set aside.
2. Each class gives up its dearest units; buckets nobody probes any more go, and of buckets with the same members one stays.
3. Every class is verified against the smallest id it shares most buckets with; links make components.
4. Buckets that still hold several components are searched between components only. Odd sketches (the parity of each of
   2n bins) differ in no more places than the sets do, so they rule pairs out without error. First each set names its
   likeliest partner; then sets with a possible partner left are compared in full, in blocks, and only links that join
   components leave a task. Rows of a bucket's largest component meet the others and never each other.

All links between different sets are found, pairs of a group are never listed.

Defined cases: null text counts as empty; a text without words has an empty set and is its own component. Rows with a null
id link with nothing and have a null component. Repeated rows share their component. An id should name one text; where it
names several, each row is placed by its own text. An empty table gives an empty result. Long texts are not cut. Other
columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .components import components, star_links
from .scratch import discard, keep, map_arrow, slices, two_columns
from .words import WordHashes, mix, shingle_sets

WIDTH, PERCENT = 3, 90
BAND_GROWTH = 1.2
# One segment in so many is indexed with deletions as well.
DELETION_SHARE = 16
BLOCK = 1024
SLICE_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Bands:
    """Size bands of a threshold: the least and largest size of each, its segments, and how many have deletions."""

    percent: int
    low: tuple[int, ...]
    high: tuple[int, ...]
    segments: tuple[int, ...]
    spare: tuple[int, ...]

    @classmethod
    def up_to(cls, size: int, percent: int) -> Bands:
        low, high, segments, spare, start = [], [], [], [], 1
        while not high or high[-1] < size:
            end = max(start, int(start * BAND_GROWTH), start * 100 // percent)
            most = 2 * end * (100 - percent) // (100 + percent)
            low.append(start)
            high.append(end)
            segments.append(most + 1)
            spare.append(max(1, (most + 1) // DELETION_SHARE) if most else 0)
            start = end + 1
        return cls(percent, tuple(low), tuple(high), tuple(segments), tuple(spare))

    def of(self, size: int) -> list[int]:
        """Bands a set of `size` takes part in; where no difference is allowed, equal sets are one class already."""
        own = bisect_right(self.low, size) - 1
        both = [own] if own + 1 == len(self.low) or 100 * size < self.percent * self.low[own + 1] else [own, own + 1]
        return [band for band in both if self.segments[band] > 1]

    def odd_bytes(self, band: int) -> int:
        return 2 * self.high[band] // 8 + 1


# More shingles than a text column can hold.
LARGEST = 1 << 31


def words_of(texts: list[str]) -> list[list[bytes]]:
    """Lower case for A-Z only; words end at ASCII white space."""
    return [text.encode().lower().split() for text in texts]


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    """Slices of a batch with the hashes of all sets, one after another, and the size of each."""
    memo = WordHashes()
    memo.LIMIT = 100_000
    for batch in slices(batches, "text", SLICE_BYTES):
        yield batch, *shingle_sets(words_of(batch.column("text").to_pylist()), width, memo)


def _taking_part(sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set, band) of every part a set takes."""
    of = {size: bands.of(size) for size in np.unique(sizes).tolist() if size}
    parts = [(i, band) for i, size in enumerate(sizes.tolist()) if size for band in of[size]]
    return np.array([i for i, _ in parts], np.int64), np.array([b for _, b in parts], np.int64)


def _spread_out(hashes: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the sets named by `owner`, one set after another, and which place of `owner` each is of."""
    starts, counts = (np.cumsum(sizes) - sizes)[owner], sizes[owner]
    part = np.repeat(np.arange(len(owner)), counts)
    return hashes[np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[part]], part


def segment_keys(hashes: np.ndarray, sizes: np.ndarray, bands: Bands):
    """Columns (set, band, segment, deletion, key) of all keys of the sets."""
    owner, band = _taking_part(sizes, bands)
    segments, spare = np.array(bands.segments)[band], np.array(bands.spare)[band]
    values, part = _spread_out(hashes, sizes, owner)
    thrown = mix(values + ODD) >> np.uint64(32)
    segment = ((thrown * segments[part].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    base = np.cumsum(segments) - segments
    place, total = base[part] + segment, int(segments.sum())
    share = mix(values ^ ODD)
    order = np.argsort(place, kind="stable")
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(share[order], dtype=np.uint64)])
    ends = np.cumsum(np.bincount(place, minlength=total))
    sums = running[ends] - running[np.concatenate([[0], ends[:-1]])] if total else running[:0]
    whose = np.repeat(np.arange(len(owner)), segments)
    number = np.arange(total) - base[whose]
    mark = mix((band[whose].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + np.uint64(1))
    cut = np.flatnonzero(segment < spare[part])
    fewer = sums[place[cut]] - share[cut]
    exact = mix(sums + mark)
    return (np.concatenate([owner[whose], owner[part[cut]]]), np.concatenate([band[whose], band[part[cut]]]),
            np.concatenate([number, segment[cut]]), np.repeat([False, True], [total, len(cut)]),
            np.concatenate([exact, mix(fewer + mark[place[cut]])]))


def odd_sketches(hashes: np.ndarray, sizes: np.ndarray, owner: np.ndarray, band: np.ndarray, bands: Bands) -> list[bytes]:
    """For each (set, band) the parity of its shingles in each bin."""
    width = np.array([bands.odd_bytes(b) for b in band.tolist()], np.int64) * 8
    values, part = _spread_out(hashes, sizes, owner)
    thrown = mix(values + ODD + ODD) >> np.uint64(32)
    bins = ((thrown * width[part].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    ends = np.cumsum(width)
    parity = (np.bincount((ends - width)[part] + bins, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8)
    packed = np.packbits(parity).tobytes()
    return [packed[(end - w) // 8:end // 8] for end, w in zip(ends.tolist(), width.tolist())]


def _digest_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hashes, sizes in _sets(batches, width):
            ends = np.cumsum(sizes)
            digests = [xxhash.xxh3_128_digest(hashes[end - size:end].tobytes()) for end, size in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())],
                                             names=["doc_id", "n_shingles", "digest"])
    return run


def _key_batches(width: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hashes, sizes in _sets(batches, width):
            owner, band, segment, deletion, key = segment_keys(hashes, sizes, bands)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ids[owner], pa.int64()), pa.array(band, pa.int32()),
                 pa.array(segment, pa.int32()), pa.array(deletion)], names=["h", "cid", "band", "segment", "deletion"])
    return run


def _set_batches(width: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hashes, sizes in _sets(batches, width):
            owner, band = _taking_part(sizes, bands)
            odds = odd_sketches(hashes, sizes, owner, band, bands)
            cuts = np.append(0, np.cumsum(np.bincount(owner, minlength=len(sizes)))).astype(np.int32)
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(band, pa.int32())),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(odds, pa.binary()))],
                names=["cid", "n", "shingles", "bands", "odds"])
    return run


def _shared_keys(keys: DataFrame) -> DataFrame:
    """Rows of the keys where two sets may meet, with the number of whole and of shortened segments there."""
    met = keep(keys.groupBy("h").agg(F.count_if(~F.col("deletion")).alias("whole"), F.count_if("deletion").alias("shorter"))
               .filter("whole > 1 or whole = 1 and shorter > 0"), "met")
    rows = met.count()
    bits = bloom.size_for(rows)
    blocks = bloom.members(met.select("h"), bits)
    # Most keys are known to be single without moving; the others meet the counts.
    near = bloom.probe(keys, F.col("h"), blocks, bits).filter("__maybe").drop("__maybe")
    return keep(near.join(met, "h"), "shared")


def _probed(shared: DataFrame, bands: Bands) -> DataFrame:
    """(h, cid, band) of the buckets that some set still probes after giving up its dearest units."""
    spark = shared.sparkSession
    # A table of fixed size: one row a band.
    spares = spark.createDataFrame(list(enumerate(bands.spare)), "band int, spare long")
    rows = shared.join(F.broadcast(spares), "band")
    always = (F.col("segment") < F.col("spare")) & ~F.col("deletion")
    cost = F.when(always, F.col("shorter")).when(F.col("deletion"), F.col("whole")).otherwise(F.col("whole") + F.col("shorter"))
    units = rows.groupBy("cid", "band", "segment", "spare").agg(F.sum(cost).alias("cost"))
    dearest = Window.partitionBy("cid", "band").orderBy(F.desc("cost"), "segment")
    given_up = units.withColumn("place", F.row_number().over(dearest)).filter("place <= spare").select(
        "cid", "band", "segment", F.lit(True).alias("given_up"))
    flagged = rows.join(given_up, ["cid", "band", "segment"], "left").withColumn(
        "probes", always | F.col("given_up").isNull())
    flagged = keep(flagged.select("h", "cid", "band", "probes"), "flagged")
    # Buckets with the same members, told by four sums of 32-bit hashes: one of them is enough.
    halves = [half for k in (0, 1) for half in (F.shiftrightunsigned(F.xxhash64("cid", F.lit(k)), 32),
                                                F.xxhash64("cid", F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF)))]
    sums = [F.sum(half).alias(f"sum{k}") for k, half in enumerate(halves)]
    buckets = flagged.groupBy("h").agg(
        F.bool_or("probes").alias("probed"), F.count(F.lit(1)).alias("n"), F.min("cid").alias("least"), *sums)
    single = buckets.filter("probed and n > 1").groupBy("n", "least", "sum0", "sum1", "sum2", "sum3").agg(F.min("h").alias("h"))
    out = keep(flagged.join(single.select("h", "least"), "h").select("h", "cid", "band", "least"), "probed")
    discard(flagged)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among `pairs` (a, b), confirmed on the full sets."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    common = near.withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return keep(common.filter(f"100 * both >= {percent} * (na + nb - both)").select("a", "b").distinct(), "verified")


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows (h, cid, band, comp) of the buckets with several components, dealt into blocks of bounded size.

    In a bucket beyond one block the largest component's parts meet the parts of all others; the others' parts meet
    each other as well. An outlier among many copies thus costs one more row a part, not a row a pair of parts.
    """
    counts = rows.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = keep(counts.groupBy("h").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "comp")).alias("top"))
                 .filter("top.n < rows").selectExpr("h", "rows", "top.n AS most", "top.comp AS main"), "mixed")
    joined = rows.join(mixed, "h").withColumn("minor", F.when(
        F.col("rows") <= block, 1).otherwise(F.ceil((F.col("rows") - F.col("most")) / block)).cast("int"))
    joined = joined.withColumn("major", F.when(F.col("rows") <= block, 0).otherwise(F.ceil(F.col("most") / block)).cast("int"))
    is_major = (F.col("major") > 0) & (F.col("comp") == F.col("main"))
    joined = joined.withColumn("part", F.when(is_major, F.col("minor") + F.pmod(F.xxhash64("cid"), F.col("major")))
                               .otherwise(F.pmod(F.xxhash64("cid"), F.col("minor"))).cast("int"))
    others = F.when(is_major, F.sequence(F.lit(0), F.col("minor") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("minor") + F.col("major") - 1))
    spread = joined.withColumn("other", F.explode(others))
    return spread.select("h", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
                         "cid", "band", "comp", "part")


def _outside_main(table: pa.Table):
    """Places of the rows outside the block's largest component, and a function that gives the rows one is to meet."""
    comp, part = table.column("comp").to_numpy(), table.column("part").to_numpy()
    names, place, counts = np.unique(comp, return_inverse=True, return_counts=True)
    minor = np.flatnonzero(place != counts.argmax())
    mixed = part.min() != part.max()
    return minor, lambda i, comp=comp: np.flatnonzero((comp != comp[i]) & (part != part[i])) if mixed else np.flatnonzero(comp != comp[i])


def _possible(table: pa.Table, percent: int):
    """For each row outside the largest component, the rows its odd sketch and size allow, and how far they are."""
    n = table.column("n").to_numpy()
    bits = np.frombuffer(b"".join(table.column("odd").to_pylist()), np.uint8).reshape(len(n), -1)
    minor, meets = _outside_main(table)
    for i in minor.tolist():
        others = meets(i)
        others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
        if len(others):
            apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            good = apart * (100 + percent) <= (n[others] + n[i]) * (100 - percent)
            if good.any():
                yield i, others[good], apart[good]


def _best_partners(percent: int):
    def run(table: pa.Table) -> pa.Table:
        cid, found = table.column("cid").to_numpy(), set()
        for i, others, apart in _possible(table, percent):
            j = others[np.lexsort((cid[others], apart))[0]]
            found.add((int(max(cid[i], cid[j])), int(min(cid[i], cid[j]))))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})
    return run


def _open_rows(percent: int):
    def run(table: pa.Table) -> pa.Table:
        open_ = np.zeros(table.num_rows, bool)
        for i, others, _ in _possible(table, percent):
            open_[i] = True
            open_[others] = True
        return table.select(["h", "cid", "band", "comp"]).filter(pa.array(open_))
    return run


def _links_between(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links confirmed on the full sets: enough of them to join what belongs together."""
        cid, comp = table.column("cid").to_numpy(), table.column("comp").to_numpy().copy()
        lists = table.column("shingles").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        n = np.diff(ends)
        minor, meets = _outside_main(table)
        found = []
        for i in minor.tolist():
            others = meets(i, comp)
            others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
            for j in others.tolist():
                if comp[j] == comp[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    found.append((int(cid[i]), int(cid[j])))
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})
    return run


def _placed(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps.withColumnRenamed("id", "cid"), "cid", "left").select(
        "h", "cid", "band", F.coalesce("component", "cid").alias("comp"))


def _joined(members: DataFrame, sets: DataFrame, bands: Bands, block: int) -> DataFrame:
    """Components (id, component) of the sets in `members` (h, cid, band, least)."""
    percent = bands.percent
    stars = members.filter("cid <> least").groupBy("cid", "least").agg(F.count(F.lit(1)).alias("n"))
    first = stars.groupBy("cid").agg(F.min_by("least", F.struct(-F.col("n"), "least")).alias("least"))
    comps = keep(components(_verified(first.select(F.col("cid").alias("a"), F.col("least").alias("b")), sets, percent)), "components")
    members = members.select("h", "cid", "band")
    odd = sets.select("cid", "n", F.explode(F.arrays_zip("bands", "odds")).alias("of")).select(
        "cid", "n", F.col("of.bands").alias("band"), F.col("of.odds").alias("odd"))

    def search(rows, compare, schema):
        blocks = _dealt(rows, block).join(odd, ["cid", "band"])
        return keep(blocks.groupBy("h", "lo", "hi").applyInArrow(compare, schema).distinct(), "found")

    pairs = search(_placed(members, comps), _best_partners(percent), "a long, b long")
    if pairs.isEmpty():
        return comps
    comps = keep(components(star_links(comps).unionByName(_verified(pairs, sets, percent))), "components")
    rest = search(_placed(members, comps), _open_rows(percent), "h long, cid long, band int, comp long")
    full = _dealt(rest, block).join(sets.select("cid", "shingles"), "cid")
    more = keep(full.groupBy("h", "lo", "hi").applyInArrow(_links_between(percent), "a long, b long").distinct(), "links")
    return comps if more.isEmpty() else keep(components(star_links(comps).unionByName(more)), "components")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                       percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (least id reachable by links)."""
    bands = Bands.up_to(LARGEST, percent)
    texts = two_columns(docs, id_col, text_col)
    sets_of = keep(map_arrow(texts, _digest_batches(width), "doc_id long, n_shingles long, digest binary"), "sizes")
    known = sets_of.filter("n_shingles > 0 and doc_id is not null")
    classes = keep(known.groupBy("digest").agg(F.min("doc_id").alias("cid")), "classes")
    copies = keep(known.select("doc_id").distinct().join(classes, F.col("doc_id") == F.col("cid"), "left_anti"), "copies")
    named = texts.filter("doc_id is not null")
    single = bloom.without(named, "doc_id", copies, copies.count())
    keys = keep(map_arrow(single, _key_batches(width, bands), "h long, cid long, band int, segment int, deletion boolean"), "keys")
    shared = _shared_keys(keys)
    members = _probed(shared, bands)
    discard(keys, shared)
    wanted = keep(members.select("cid").distinct(), "wanted")
    sets = keep(map_arrow(bloom.within(named, "doc_id", wanted, wanted.count()), _set_batches(width, bands),
                          "cid long, n long, shingles array<long>, bands array<int>, odds array<binary>"), "sets")
    comps = _joined(members, sets, bands, block)
    labels = keep(classes.join(comps.withColumnRenamed("id", "cid"), "cid", "left").select(
        "digest", F.coalesce("component", "cid").alias("component_id")), "labels")
    discard(sets, members)
    # Empty sets get a key of their own, so that they do not meet in one task.
    own = F.col("doc_id").cast("string").cast("binary")
    keyed = sets_of.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).otherwise(own).alias("digest"))
    return keyed.join(labels, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
