"""Near-dedup of texts: fast similarity sketches, banding, exact verification, components.

A sketch has `COORDINATES` coordinates. In round i each shingle is thrown into one bin by the i-th hash
and offers the value (i, fraction); a bin keeps its least value. Rounds go on until every bin is filled;
from round `COORDINATES` on bin i alone is fed, so that each is filled in the end. Coordinates of two sets agree
with their Jaccard similarity as probability, and as concentrated as independent samples.

1. Texts with equal shingle sets are one class; the class of the smallest id stands for them.
2. Coordinates are cut into bands. Band values met once are ruled out by a Bloom filter, without a shuffle.
3. Every class is compared with the leader it shares most bands with; links are confirmed on the full sets.
4. Buckets that still hold several components are searched again, between components only. First each class
   meets its likeliest partner there. Then all that remain are compared block by block on their full sets, inside the
   tasks, which return only the links that join components. Sketches rule out pairs far below the threshold (six
   standard deviations). Links inside a component are implied, and pairs of a group are never listed.

A pair at the threshold shares no band with a probability of about 2e-6, less above it. Nothing else loses links.

Defined cases: null text counts as empty; a text without words has an empty set, is its own
component and stays. Rows with a null id stand for no one: they are returned with a null component and stay.
An id names one text; repeated rows share class and verdict. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .components import components, star_links
from .scratch import discard, keep, map_arrow, slices, two_columns
from .words import WordHashes, mix, shingle_sets

WIDTH = 5
PERCENT = 75
BANDS, ROWS = 48, 5
COORDINATES = BANDS * ROWS
# A pair at the threshold has this share of equal coordinates or less once in 10^8.
LIKELY = 0.58
BLOCK = 512
BITS_MEMORY = 64 << 20
STEP = 0x9E3779B97F4A7C15


def words_of(texts: list[str]) -> list[list[bytes]]:
    """Lower case for A-Z only; words end at ASCII white space."""
    return [text.encode().lower().split() for text in texts]


def sketch(hashes: np.ndarray, sizes: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Sketches of many sets at once, a row of `t` 16-bit coordinates each; empty sets get zeros."""
    n = len(sizes)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(n * t, empty, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    values = hashes
    low = np.uint64((1 << 48) - 1)
    for turn in range(2 * t):
        if not len(values):
            break
        thrown = mix(values + np.uint64((turn + 1) * STEP & 0xFFFFFFFFFFFFFFFF))
        if turn < t:
            place = owner * t + ((thrown >> np.uint64(48)) * np.uint64(t) >> np.uint64(16)).astype(np.int64)
        else:
            place = owner * t + (turn - t)
        open_ = least[place] == empty
        offer = (thrown & low) | (np.uint64(turn) << np.uint64(48))
        np.minimum.at(least, place[open_], offer[open_])
        if turn < t and turn % 4 and len(values) > t:
            continue
        unfilled = (least.reshape(n, t) == empty).any(axis=1)
        going = unfilled[owner]
        owner, values = owner[going], values[going]
    short = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16).reshape(n, t)
    short[sizes == 0] = 0
    return short


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in slices(batches):
        hashes, sizes = shingle_sets(words_of(batch.column("text").to_pylist()), WIDTH, memo)
        rows = sketch(hashes, sizes)
        ends = np.cumsum(sizes)
        digests = [xxhash.xxh3_128_digest(hashes[end - size:end].tobytes()) for end, size in zip(ends, sizes)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             pa.array([row.tobytes() for row in rows], pa.binary())],
            names=["doc_id", "n_shingles", "digest", "sketch"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in slices(batches):
        hashes, sizes = shingle_sets(words_of(batch.column("text").to_pylist()), WIDTH, memo)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))],
            names=["cid", "shingles"])


def _band_keys(classes: DataFrame) -> DataFrame:
    """(cid, h): one hash for each band of a class."""
    width = 2 * ROWS
    keys = [F.xxhash64(F.lit(band), F.substring("sketch", band * width + 1, width)) for band in range(BANDS)]
    return classes.select("cid", F.explode(F.array(*keys)).alias("h"))


def _shared_bands(classes: DataFrame) -> DataFrame:
    """(cid, h) for the bands that two classes or more have in common, perhaps a few more."""
    keys = _band_keys(classes)
    bits = bloom.size_for(classes.count() * BANDS, per_row=8, max_bits=1 << 27)
    blocks = bloom.repeated(keys.select("h"), bits, number=1)
    return keep(bloom.probe(keys, F.col("h"), blocks, bits, number=1).filter("__maybe").select("cid", "h"), "bands")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among `pairs` (a, b), confirmed on the full sets."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    sized = pairs.join(left, "a").join(right, "b").withColumn("na", F.size("sa")).withColumn("nb", F.size("sb"))
    near = sized.filter(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    common = near.withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return keep(common.filter(f"100 * both >= {PERCENT} * (na + nb - both)").select("a", "b"), "verified")


def _others(table: pa.Table):
    """For each row of a block, the rows of other components that its sketch makes likely, and how alike they are."""
    comp = table.column("comp").to_numpy()
    part = table.column("part").to_numpy()
    raw = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(comp), COORDINATES)
    low, high = part.min(), part.max()
    for i in range(len(comp)):
        # Rows of one part are compared in the block that is theirs alone.
        others = np.flatnonzero((comp != comp[i]) & ((part != part[i]) if low != high else True))
        if len(others):
            alike = (raw[others] == raw[i]).mean(axis=1)
            good = alike >= LIKELY
            if good.any():
                yield i, others[good], alike[good]


def _best_partners(table: pa.Table) -> pa.Table:
    """The likeliest partner of each row: one pair a row at most."""
    cid, found = table.column("cid").to_numpy(), {}
    for i, others, alike in _others(table):
        j = others[np.lexsort((cid[others], -alike))[0]]
        found[max(cid[i], cid[j]), min(cid[i], cid[j])] = None
    return pa.table({"a": pa.array([int(a) for a, _ in found], pa.int64()),
                     "b": pa.array([int(b) for _, b in found], pa.int64())})


def _open_rows(table: pa.Table) -> pa.Table:
    """Rows that have a likely partner in another component."""
    rows = [i for i, _, _ in _others(table)]
    return table.select(["h", "cid", "comp"]).take(pa.array(rows, pa.int64()))


def _common_sizes(flat: np.ndarray, sizes: np.ndarray):
    """A function of a row and other rows that gives the sizes of their common sets."""
    ends = np.cumsum(sizes)
    distinct, place = np.unique(flat, return_inverse=True)
    width = (len(distinct) + 7) // 8
    if width * len(sizes) <= BITS_MEMORY:
        bits = np.zeros((len(sizes), width), np.uint8)
        np.bitwise_or.at(bits, (np.repeat(np.arange(len(sizes)), sizes), place >> 3), (1 << (place & 7)).astype(np.uint8))
        return lambda i, others: np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
    rows = [flat[end - size:end] for end, size in zip(ends, sizes)]
    return lambda i, others: np.array([len(np.intersect1d(rows[i], rows[j], assume_unique=True)) for j in others])


def _links_between(table: pa.Table) -> pa.Table:
    """Links between components of a block, confirmed on the full sets: enough of them to join what belongs together."""
    cid, comp, part = (table.column(n).to_numpy() for n in ("cid", "comp", "part"))
    arrays = table.column("shingles").combine_chunks()
    sizes = np.diff(arrays.offsets.to_numpy())
    common = _common_sizes(arrays.flatten().to_numpy(), sizes)
    comp, mixed, found = comp.copy(), part.min() != part.max(), []
    for i in range(len(cid)):
        others = np.flatnonzero((comp != comp[i]) & ((part != part[i]) if mixed else True))
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= PERCENT * np.maximum(sizes[others], sizes[i])]
        if not len(others):
            continue
        both = common(i, others)
        for j in others[100 * both >= PERCENT * (sizes[others] + sizes[i] - both)]:
            if comp[j] != comp[i]:
                found.append((int(cid[i]), int(cid[j])))
                comp[comp == comp[j]] = comp[i]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _mixed(members: DataFrame) -> DataFrame:
    """Rows (h, cid, comp) of the buckets that hold several components, dealt into blocks of bounded size.

    A bucket of many blocks is compared block by block; each of its rows then goes to as many tasks. Where one component
    makes up most of it, its rows are parts by themselves and only meet the parts of the others, as links inside
    a component are implied: they move as often as the others have parts, mostly once.
    """
    comps = members.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = comps.groupBy("h").agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"))
    dealt = mixed.filter("k > 1").selectExpr(
        "h", "most.comp AS major", "n", "most.m AS m", f"ceil(n / {BLOCK}) AS parts",
        f"ceil(most.m / {BLOCK}) AS own", f"ceil((n - most.m) / {BLOCK}) AS rest")
    dealt = keep(dealt.selectExpr("h", "major", "parts", "own", "rest", "m * rest + (n - m) * (own + rest) < n * parts AS apart"), "mixed")
    rows = members.join(dealt, "h").withColumn("inside", F.col("apart") & (F.col("comp") == F.col("major"))).withColumn(
        "part", F.expr("""cast(CASE WHEN inside THEN pmod(xxhash64(cid), own) WHEN apart THEN own + pmod(xxhash64(cid), rest)
                                    ELSE pmod(xxhash64(cid), parts) END AS int)"""))
    spread = rows.withColumn("other", F.expr(
        "explode(sequence(cast(if(inside, own, 0) AS int), cast(if(apart, own + rest, parts) AS int) - 1))"))
    return spread.select("h", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
                         "cid", "comp", "part")


def _placed(shared: DataFrame, comps: DataFrame) -> DataFrame:
    return shared.join(comps.withColumnRenamed("id", "cid"), "cid", "left").select(
        "h", "cid", F.coalesce("component", "cid").alias("comp"))


def _search(shared: DataFrame, classes: DataFrame, comps: DataFrame, compare, schema: str) -> DataFrame:
    """What `compare` finds in the blocks of mixed buckets, by sketches."""
    blocks = _mixed(_placed(shared, comps)).join(classes.select("cid", "sketch"), "cid")
    return keep(blocks.groupBy("h", "lo", "hi").applyInArrow(compare, schema).distinct(), "found")


def find_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable by links), kept."""
    sketched = keep(map_arrow(two_columns(docs, id_col, text_col), _sketch_batches,
                              "doc_id long, n_shingles long, digest binary, sketch binary"), "sketches")
    classes = keep(
        sketched.filter("n_shingles > 0 and doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("cid"), F.first("sketch").alias("sketch")), "classes")
    bands = _shared_bands(classes)
    buckets = keep(
        bands.groupBy("h").agg(F.min_by("cid", F.xxhash64("h", "cid")).alias("leader"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("h", "leader"), "buckets")
    shared = keep(bands.join(buckets, "h"), "shared")
    stars = shared.filter("cid <> leader").groupBy("cid", "leader").agg(F.count(F.lit(1)).alias("n"))
    first = keep(stars.groupBy("cid").agg(F.max_by("leader", F.struct("n", "leader")).alias("leader"))
                 .select(F.greatest("cid", "leader").alias("a"), F.least("cid", "leader").alias("b")).distinct(), "pairs")
    wanted = keep(shared.select("cid").distinct(), "wanted")
    texts = bloom.within(two_columns(docs, id_col, text_col), "doc_id", wanted, wanted.count())
    sets = keep(map_arrow(texts, _set_batches, "cid long, shingles array<long>"), "sets")
    comps = keep(components(_verified(first, sets)), "components")
    members = shared.select("cid", "h")
    pairs = _search(members, classes, comps, _best_partners, "a long, b long")
    if not pairs.isEmpty():
        comps = keep(components(star_links(comps).unionByName(_verified(pairs, sets))), "components")
        rest = _search(members, classes, comps, _open_rows, "h long, cid long, comp long")
        blocks = _mixed(rest).join(sets, "cid")
        more = keep(blocks.groupBy("h", "lo", "hi").applyInArrow(_links_between, "a long, b long"), "links")
        if not more.isEmpty():
            comps = keep(components(star_links(comps).unionByName(more)), "components")
    discard(sets)
    named = classes.select("digest", "cid").join(comps.withColumnRenamed("id", "cid"), "cid", "left").select(
        "digest", F.coalesce("component", "cid").alias("component_id"))
    labels = keep(named, "labels")
    # Empty sets get a key of their own, so that they do not meet in one task.
    keyed = sketched.select("doc_id", "n_shingles",
                            F.when(F.col("n_shingles") > 0, F.col("digest")).otherwise(F.col("doc_id").cast("string").cast("binary"))
                            .alias("digest"))
    out = keyed.join(labels, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component, the one of the least id, with all its columns."""
    lost = keep(find_components(docs, id_col, text_col).filter("not kept").select("doc_id").distinct(), "lost")
    return bloom.without(docs, id_col, lost, lost.count())
