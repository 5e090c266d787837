"""Prefix trie of conversations, by truncation peeling.

Peeling descends from the greatest depth: the conversations that end at a depth are merged with the nodes that survive
from below, equal paths become one node, its sums are complete, and its last turn is stripped. Nodes are found and summed
in the same pass; no level is visited twice.

1. Each turn becomes a digest and each prefix a 128-bit chain, the sum of its turns' digests mixed with their places.
2. Equal conversations become one path with a count. Their ids are hashed in order by runs: sorted ranges write pieces of
   the id list, and one pass over the pieces digests them, so no list of members is held anywhere.
3. A path is dealt to the bucket of its shortest prefix of 1, 2, 4, 8 ... turns that `most_paths` paths or fewer
   share. A bucket is peeled inside a task, down to that prefix; many small buckets at once, level by level.
4. What is above the buckets is peeled by Spark, one combined aggregation a level: a first turn that a third of all
   conversations share arrives as partial sums. Without such a prefix only the root is left to this step.

`splice` rebuilds conversations out of two before the trie is built.

Defined cases: null roles and texts count as empty. Turns are ordered by number, nulls first, then by digest; repeated
rows are turns of their own. Rows with a null conv_id belong to no conversation and are left out. A conversation without
turns ends at the root. An empty table has no nodes. Other columns are not looked at. The digests of one
conversation (24 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .scratch import keep, map_arrow
from .words import mix

MOST_PATHS = 4096
# Turns peeled together in a task, whole buckets at a time.
PEEL_TURNS = 400_000
STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
COLUMNS = [field.split()[0] for field in NODE.split(", ")]
PEELED = NODE + ", up_chains array<binary>, up_sizes array<long>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): for each turn in order a digest of role and text, and the bytes of the text."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(digest, 1, 32)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    grouped = rows.filter("conv_id is not null").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "digest", "bytes"))).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"], t["bytes"])).alias("turns"))


def splice(convs: DataFrame, group: int = 5, most_head: int = 9) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of c - c % group; h = crc32(c) % most_head."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_head
    base = F.col("conv_id") - F.col("conv_id") % group
    rows = convs.select("conv_id", base.alias("base"), head.cast("int").alias("head"), "turns")
    heads = convs.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most_head).alias("first"))
    joined = rows.join(heads, "base", "left")
    own = F.when(F.size("turns") > F.col("head"),
                 F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns") - F.col("head"), F.lit(0))))
    none = F.slice("turns", 1, 0)
    start = F.slice(F.coalesce("first", none), F.lit(1), F.col("head"))
    return joined.select("conv_id", F.concat(start, F.coalesce(own, none)).alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of all prefixes of each conversation, as bytes, and those of 1, 2, 4, 8 ... turns as marks."""
    for whole in batches:
        for start in range(0, whole.num_rows, 2048):
            batch = whole.slice(start, 2048)
            lists = batch.column("turns")
            counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            turns = lists.flatten()
            raw = np.frombuffer(b"".join(turns.field("digest").to_pylist()), np.uint64).reshape(-1, 2)
            sizes = turns.field("bytes").to_numpy().astype(np.int64)
            ends = np.cumsum(counts)
            place = (np.arange(len(raw)) - np.repeat(ends - counts, counts) + 1).astype(np.uint64)
            lanes = []
            for k in (0, 1):
                summed = np.cumsum(mix(raw[:, k] + place * STEPS[k]), dtype=np.uint64)
                before = np.concatenate([[np.uint64(0)], summed])[ends - counts]
                lanes.append(summed - np.repeat(before, counts))
            chains = np.stack(lanes, axis=1).tobytes()
            packed, last, marks = [], [], []
            for end, n in zip(ends.tolist(), counts.tolist()):
                path = chains[16 * (end - n):16 * end]
                packed.append(path)
                last.append(path[-16:])
                marks.append([path[16 * (1 << j) - 16:16 * (1 << j)] for j in range(n.bit_length())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(counts), pa.array(last, pa.binary()), pa.array(marks, pa.list_(pa.binary())),
                 pa.array(packed, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(sizes))],
                names=["conv_id", "n", "chain", "marks", "chains", "sizes"])


def _id_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (chain, conv_id) rows as runs of a chain: its first id, their number, and the ids as text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        chains, ids = batch.column("chain").to_pylist(), batch.column("conv_id").to_pylist()
        starts = [0] + [i for i in range(1, len(ids)) if chains[i] != chains[i - 1]]
        cuts = list(zip(starts, [*starts[1:], len(ids)]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([chains[a] for a, _ in cuts], pa.binary()), pa.array([ids[a] for a, _ in cuts], pa.int64()),
             pa.array([b - a for a, b in cuts], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in cuts])],
            names=["chain", "first", "n", "ids"])


def _run_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a chain from its sorted runs; a digest goes on from batch to batch."""
    open_chain, first, number, digest = None, 0, 0, None
    for batch in batches:
        done = []
        for chain, low, n, ids in zip(*(batch.column(c).to_pylist() for c in ("chain", "first", "n", "ids"))):
            if chain != open_chain:
                if digest:
                    done.append((open_chain, first, number, digest.hexdigest()))
                open_chain, first, number, digest = chain, low, 0, hashlib.sha256()
            digest.update((b"," if number else b"") + ids.encode())
            number += n
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("chain", "first", "members", "ends"), row)) for row in done])
    if digest:
        yield pa.RecordBatch.from_pylist(
            [{"chain": open_chain, "first": first, "members": number, "ends": digest.hexdigest()}])


def _classes(paths: DataFrame) -> DataFrame:
    """Equal conversations: (chain, first id, number of members, digest of their ids in order)."""
    ids = paths.select("chain", "conv_id")
    runs = map_arrow(ids.repartitionByRange("chain", "conv_id").sortWithinPartitions("chain", "conv_id"), _id_runs,
                     "chain binary, first long, n long, ids string")
    return map_arrow(runs.repartition("chain").sortWithinPartitions("chain", "first"), _run_digests,
                     "chain binary, first long, members long, ends string")


def _bucketed(reps: DataFrame, most_paths: int) -> DataFrame:
    """`reps` with `bucket` and its depth `top`; null where every mark is shared by more paths than a bucket takes."""
    marks = reps.select("conv_id", F.posexplode("marks").alias("j", "mark"))
    large = keep(marks.groupBy("mark").count().filter(F.col("count") > most_paths).select("mark"), "large")
    if large.isEmpty():
        return reps.withColumn("bucket", F.get("marks", F.lit(0))).withColumn(
            "top", F.when(F.size("marks") > 0, F.lit(1).cast("long"))).drop("marks")
    hot = marks.join(small_side(large), "mark").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("hot"))
    rows = reps.join(hot, "conv_id", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    return rows.withColumn("bucket", F.get("marks", F.col("hot"))).withColumn(
        "top", F.expr("if(bucket is null, null, shiftleft(1L, hot))")).drop("marks", "hot")


class _Nodes:
    """Nodes found so far, in chunks of a level or of a stretch without branches."""

    def __init__(self):
        self.count, self.chunks, self.parents = 0, [], []

    def add(self, conv, depth, n, children, leaves, saved, ends, who) -> np.ndarray:
        at = np.arange(self.count, self.count + len(conv))
        self.chunks.append((conv, np.broadcast_to(depth, len(conv)), n, children, leaves, saved, ends, who))
        self.count += len(conv)
        return at

    def set_parents(self, at: np.ndarray, conv: np.ndarray) -> None:
        self.parents.append((at, conv))

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate([chunk[k] for chunk in self.chunks]) for k in range(8)]


def peel(conv, n, top, members, chains, sizes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Nodes of whole buckets: columns of `_Nodes`, each node's parent's id, and which nodes are tops of their bucket.

    `ends` in the columns is the place of the path that ends at a node, or -1; `who` a path through it.
    """
    nodes = _Nodes()
    offset = np.cumsum(n) - n
    by_depth = np.argsort(-n, kind="stable")
    depths = n[by_depth]
    depth, next_end = int(depths[0]), 0
    empty = np.zeros(0, np.int64)
    alive = dict(who=empty, conv=empty, n=empty, leaves=empty, saved=empty, at=empty)
    tops = []
    while len(alive["who"]) or next_end < len(depths):
        if not len(alive["who"]):
            depth = int(depths[next_end])
        stop = int(np.searchsorted(-depths, -depth, "right"))
        ended, next_end = by_depth[next_end:stop], stop
        old = len(alive["who"])
        if old == 1 and not len(ended):
            # Nothing can join a lone path before the next conversation ends: strip all of that stretch at once.
            i = int(alive["who"][0])
            low = max(int(top[i]), int(depths[next_end]) + 1 if next_end < len(depths) else 1)
            stretch = np.arange(depth, low - 1, -1)
            size = sizes[offset[i] + stretch - 1]
            ones = np.ones(len(stretch), np.int64)
            members_here = ones * alive["n"][0]
            saved = alive["saved"][0] + np.cumsum((members_here - 1) * size)
            at = nodes.add(ones * alive["conv"][0], stretch, members_here, ones, ones * alive["leaves"][0], saved, -ones, ones * i)
            nodes.set_parents(np.append(alive["at"], at[:-1]), ones * alive["conv"][0])
            alive = dict(alive, saved=saved[-1:], at=at[-1:])
            depth = low
        else:
            who = np.concatenate([alive["who"], ended])
            key = chains[offset[who] + depth - 1]
            order = np.lexsort((key[:, 1], key[:, 0]))
            key = key[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            is_old = order < old

            def summed(name, other):
                return np.add.reduceat(np.concatenate([alive[name], other])[order], first)

            zeros = np.zeros(len(ended), np.int64)
            total = summed("n", members[ended])
            least = np.minimum.reduceat(np.concatenate([alive["conv"], conv[ended]])[order], first)
            children = np.add.reduceat(is_old.astype(np.int64), first)
            leaves = np.where(children > 0, summed("leaves", zeros), 1)
            path = who[order][first]
            saved = summed("saved", zeros) + (total - 1) * sizes[offset[path] + depth - 1]
            ends = np.maximum.reduceat(np.where(is_old, -1, who[order]), first)
            at = nodes.add(least, depth, total, children, leaves, saved, ends, path)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(who))))
            nodes.set_parents(alive["at"][order[is_old]], least[group[is_old]])
            alive = dict(who=path, conv=least, n=total, leaves=leaves, saved=saved, at=at)
        is_top = top[alive["who"]] == depth
        if is_top.any():
            tops.append(alive["at"][is_top])
            alive = {name: column[~is_top] for name, column in alive.items()}
        depth -= 1
    parent = np.full(nodes.count, -1, np.int64)
    for at, least in nodes.parents:
        parent[at] = least
    return nodes.columns(), parent, np.concatenate(tops)


def _peel_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Nodes of the paths (conv, n, top, members, ends, chains, sizes) of whole buckets."""
    conv, n, top, members = (np.array([row[k] for row in rows], np.int64) for k in range(4))
    chains = np.frombuffer(b"".join(row[5] for row in rows), np.uint64).reshape(-1, 2)
    sizes = np.array([size for row in rows for size in row[6]], np.int64)
    (first, depth, total, children, leaves, saved, ends, who), parent, tops = peel(conv, n, top, members, chains, sizes)
    is_top = np.zeros(len(first), bool)
    is_top[tops] = True
    up_chains, up_sizes = [None] * len(first), [None] * len(first)
    for at in tops.tolist():
        row, k = rows[who[at]], int(depth[at]) - 1
        up_chains[at] = [row[5][16 * i:16 * i + 16] for i in range(k)]
        up_sizes[at] = row[6][:k]
    return pa.RecordBatch.from_arrays(
        [pa.array(first), pa.array(depth), pa.array(parent, mask=is_top), pa.array(total), pa.array(children), pa.array(leaves),
         pa.array(saved), pa.array([rows[i][4] if i >= 0 else NO_ENDS for i in ends.tolist()], pa.string()),
         pa.array(up_chains, pa.list_(pa.binary())), pa.array(up_sizes, pa.list_(pa.int64()))],
        names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
               "up_chains", "up_sizes"])


def _peel_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peel sorted buckets, as many whole ones at once as hold PEEL_TURNS turns."""
    waiting, turns, last = [], 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "conv_id", "n", "top", "members", "ends", "chains", "sizes")]
        for bucket, *row in zip(*columns):
            if bucket != last and turns >= PEEL_TURNS:
                yield _peel_rows(waiting)
                waiting, turns = [], 0
            last = bucket
            waiting.append(tuple(row))
            turns += row[1]
    if waiting:
        yield _peel_rows(waiting)


def _last(column: str, none):
    return F.when(F.size(column) > 0, F.element_at(column, -1)).otherwise(none)


def _without_last(column: str):
    return F.when(F.size(column) > 0, F.slice(column, F.lit(1), F.size(column) - 1)).otherwise(F.col(column))


def _peel_above(tops: DataFrame, early: DataFrame) -> DataFrame:
    """Nodes above the buckets, found a level at a time, and the tops of the buckets, now that their parents are known."""
    deepest = max(tops.agg(F.max("depth")).first()[0] or 0, (early.agg(F.max("depth")).first()[0] or 0) + 1)
    found, below = [], None
    for depth in range(deepest - 1, -1, -1):
        children = tops.filter(F.col("depth") == depth + 1)
        if below is not None:
            children = children.unionByName(below.drop("chain"))
        sums = ("conv_id", "n_convs", "is_child", "n_leaves", "saved_tokens", "ends_sha256", "up_chains", "up_sizes")
        rows = children.withColumn("is_child", F.lit(1)).withColumn("ends_sha256", F.lit(None).cast("string")).select(*sums).unionByName(
            early.filter(F.col("depth") == depth).withColumn("is_child", F.lit(0)).select(*sums))
        chain = _last("up_chains", F.lit(b"")).alias("chain")
        level = rows.groupBy(chain).agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("is_child").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends"),
            F.min("up_chains").alias("up_chains"), F.min("up_sizes").alias("up_sizes"))
        below = keep(level.select(
            "chain", "conv_id", F.lit(depth).cast("long").alias("depth"), "n_convs", "n_children",
            F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(F.lit(1)).cast("long").alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * _last("up_sizes", F.lit(0))).alias("saved_tokens"),
            F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
            _without_last("up_chains").alias("up_chains"), _without_last("up_sizes").alias("up_sizes")), "level")
        parents = below.select("chain", F.col("conv_id").alias("parent_conv_id"))
        found.append(children.withColumn("chain", chain).join(small_side(parents), "chain").select(*COLUMNS))
    nodes = below.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*COLUMNS)
    for level in found:
        nodes = nodes.unionByName(level)
    return nodes


def build_trie(convs: DataFrame, most_paths: int = MOST_PATHS) -> DataFrame:
    """One row per node of the trie of (conv_id, turns): its smallest member, depth, parent's smallest member, members,
    children, childless nodes below it (itself included), bytes its subtree saves, and a digest of who ends there."""
    paths = keep(map_arrow(convs, _paths, "conv_id long, n long, chain binary, marks array<binary>, chains binary, sizes array<long>"), "paths")
    classes = keep(_classes(paths), "classes")
    single = paths.drop("chain").join(classes.drop("chain").withColumnRenamed("first", "conv_id"), "conv_id")
    reps = keep(_bucketed(single, most_paths), "reps")
    dealt = reps.filter("bucket is not null").repartition("bucket").sortWithinPartitions("bucket")
    peeled = keep(map_arrow(dealt.select("bucket", "conv_id", "n", "top", "members", "ends", "chains", "sizes"), _peel_buckets, PEELED), "peeled")
    chains = F.expr("transform(slice(sequence(0, cast(n as int)), 1, cast(n as int)), i -> substring(chains, i * 16 + 1, 16))")
    early = reps.filter("bucket is null").select(
        "conv_id", F.col("n").alias("depth"), F.col("members").alias("n_convs"), F.lit(0).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.col("ends").alias("ends_sha256"), chains.alias("up_chains"),
        F.col("sizes").alias("up_sizes"))
    tops = peeled.filter("up_chains is not null").drop("parent_conv_id")
    inner = peeled.filter("up_chains is null").select(*COLUMNS)
    return inner.unionByName(_peel_above(tops, early))
