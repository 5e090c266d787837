"""Exact, near and substring dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from calledzone.llm import bloom, exact_dedup, near_dup, suffix_dedup
from calledzone.llm.components import components


def test_exact_copies(spark, odd_docs, odd_rows):
    groups = defaultdict(list)
    for i, text in odd_rows:
        groups[text or ""].append(i)
    want = sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
                  for text, ids in groups.items() for i in ids)
    got = exact_dedup.find_copies(odd_docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == want
    # A filter far too small changes nothing but the rows that are shuffled.
    tight = exact_dedup.find_copies(odd_docs, max_bits=bloom.BLOCK_BITS).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, tight.collect())) == want


def test_exact_drop_keeps_columns(odd_docs):
    left = exact_dedup.drop_copies(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 5, 7, 7, 8, 9, 10, 11, 12]


def test_bloom_work_columns_are_unused_names(spark):
    """Columns named like every work column stay, also in other letter case, and change nothing."""
    names = ["__hash", "__maybe", "__id", "__id_", "__BLOCK0", *[f"__{n}{i}" for i in (0, 1) for n in ("slot", "block", "bits") if (n, i) != ("block", 0)]]
    docs = spark.createDataFrame([(i, "same" if i < 4 else f"text {i}") for i in range(20)], "doc_id long, text string")
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id >= 3)
    ids = docs.filter("doc_id % 3 = 0").select("doc_id")
    inside = bloom.within(docs, "doc_id", ids, 20)
    assert inside.columns == docs.columns
    assert sorted(map(tuple, inside.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id % 3 == 0)


def test_exact_null_ids(spark, no_docs):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.find_copies(docs).collect()), key=str)
    assert got == sorted([(3, 3, True), (None, 3, False), (None, 3, False), (None, None, True), (None, None, True)], key=str)
    assert exact_dedup.find_copies(no_docs).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def near(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.find_components(docs).collect()}


def test_near_copies_odd_rows(odd_docs, odd_rows, no_docs):
    assert near(odd_docs) == brute_components(odd_rows)
    assert near_dup.find_components(no_docs).count() == 0
    left = near_dup.drop_near_copies(odd_docs)
    assert left.columns == odd_docs.columns
    want = {i for i, (_, c) in brute_components(odd_rows).items() if i == c}
    assert {r.doc_id for r in left.collect()} == want


def test_near_copies_large_group(spark):
    """A hub with copies that mostly do not resemble each other enough, a chain, and strangers."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]

    def changed(base, n):
        base = list(base)
        for _ in range(n):
            base[rng.randrange(len(base))] = rng.choice(words)
        return base

    hub = rng.choices(words, k=160)
    texts = [changed(hub, rng.randint(1, 7)) for _ in range(250)] + [hub]
    link = rng.choices(words, k=100)
    for _ in range(30):
        texts.append(link)
        link = changed(link, 1)
    texts += [rng.choices(words, k=rng.randint(0, 60)) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert near(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)) == brute_components(rows)


def test_near_matches_brute_force_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert near(docs) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def cut(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[k:k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        covered = bytearray(len(b))
        done = 0
        for k in range(len(b) - length + 1):
            if counts[b[k:k + length]] > 1:
                covered[max(k, done):k + length] = b"\x01" * (k + length - max(k, done))
                done = k + length
        spans = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        out.append((i, len(b), sum(covered), spans, bytes(c for c, x in zip(b, covered) if not x)))
    return sorted(out)


def test_repeats_match_brute_force(spark, small, no_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == cut([(r.doc_id, r.text) for r in docs.collect()])
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_repeats_odd_texts(spark):
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh ", k=330))
    rows = [(1, "x" * 700), (2, "head " + passage + " tail"), (3, passage[:199]), (4, "é" + passage[5:206] + "ß"), (5, None), (6, ""),
            (7, "abcdefgh" * 90), (8, passage + "!" + passage), (9, "".join(rng.choices("abc", k=4000))), (10, "y" * 199)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == cut(rows)


def test_repeats_shared_with_null_ids(spark):
    """Passages that stand elsewhere only in rows without an id, phrases shared with such rows, and copies of them."""
    rng = random.Random(6)
    free = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    one, two, three = free(210), free(900), free(320)
    rows = [(None, free(300) + one + free(300)), (1, free(400) + one + free(100)), (None, two), (2, free(50) + two + free(50)),
            (3, two[100:500] + free(300)), (None, free(80) + three), (None, free(90) + three[3:]), (4, three[10:250] + free(40)),
            (None, two), (-5, free(250)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in suffix_dedup.remove_repeats(docs).collect()]
    numbered = [(1000 + n if i is None else i, text) for n, (i, text) in enumerate(rows)]
    want = cut(numbered)
    assert [row[2] > 0 for row in want if row[0] < 1000] == [False, True, True, True, True]
    assert sum(row[2] > 0 for row in want if row[0] >= 1000) == 5
    assert sorted(row for row in got if row[0] is not None) == [row for row in want if row[0] < 1000]
    assert sorted(row[1:] for row in got if row[0] is None) == sorted(row[1:] for row in want if row[0] >= 1000)


def test_repeats_long_runs_and_repeated_rows(spark):
    """A run of one byte of 1 MB, a document that is given twice, and columns named like the work columns."""
    rng = random.Random(8)
    free = "".join(rng.choices("abcdefgh ", k=500))
    rows = [(1, "z" * 1_000_000), (2, "head " + "z" * 250 + " tail"), (3, free), (3, free), (4, free[:150] + "z" * 199)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "start", "stop", "spans", "entry", "once", "h", "__hash", "__maybe"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs.repartition(3)).collect())
    assert got == [(1, 1_000_000, 1_000_000, 1), (2, 260, 250, 1), (3, 500, 500, 1), (3, 500, 500, 1), (4, 349, 0, 0)]


def test_a_large_component_moves_once(spark):
    """Rows of a bucket's largest component go to the parts of the others alone; rows of different components still meet."""
    rows = [(1, i, 1) for i in range(5000)] + [(1, 10_000 + i, 10_000 + i // 2) for i in range(20)]
    rows += [(2, i, i % 3) for i in range(1300)] + [(3, 7, 7), (3, 8, 8)]
    members = spark.createDataFrame(rows, "h long, cid long, comp long")
    dealt = near_dup._mixed(members).toPandas()
    large = dealt[dealt.h == 1]
    assert len(large) <= 5000 + 20 * 12
    assert dealt.groupby(["h", "lo", "hi"]).size().max() <= 3 * near_dup.BLOCK
    met = {1: set(), 2: set(), 3: set()}
    for (h, lo, hi), block in dealt.groupby(["h", "lo", "hi"]):
        of = list(zip(block.cid, block.comp, block.part))
        met[h] |= {(a, b) for a, x, p in of for b, y, q in of if a < b and x != y and (p != q or lo == hi)}
    for h in met:
        own = [(cid, comp) for at, cid, comp in rows if at == h]
        assert met[h] >= {(a, b) for a, x in own for b, y in own if a < b and x != y}
