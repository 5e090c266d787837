"""N-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from calledzone.llm import ngram_join
from calledzone.llm.ngram_join import Bands, segment_keys

BANDS = Bands.up_to(100_000, 90)


def shingles(text, width=3):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1))


def brute(rows, percent=90, width=3):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, **options).collect()}


def test_odd_rows(odd_docs, odd_rows, no_docs, spark):
    assert found(odd_docs) == brute(odd_rows)
    assert ngram_join.jaccard_components(odd_docs).count() == len(odd_rows)
    assert ngram_join.jaccard_components(no_docs).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (9, text + " x"), (-4, text), (None, None)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(
        [(None, 38, None), (None, 38, None), (9, 39, -4), (-4, 38, -4), (None, 0, None)], key=str)


def test_partners_meet_in_a_probed_key():
    """Sets as far apart as a link allows: whatever units one gives up, a key that it still probes is one of the other's."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(9, 400))
        most = 2 * n * 10 // 190
        base = rng.integers(0, 1 << 63, n + most, dtype=np.uint64)
        gone = int(rng.integers(0, most + 1))
        one, two = base[:n], np.concatenate([base[gone:n], base[n:n + most - gone]])
        both = n - gone
        if 100 * both < 90 * (len(one) + len(two) - both):
            continue
        owner, band, segment, deletion, key = segment_keys(np.concatenate([one, two]), np.array([len(one), len(two)]), BANDS)
        for b in set(band[owner == 0].tolist()) & set(band[owner == 1].tolist()):
            mine, other = (owner == 0) & (band == b), (owner == 1) & (band == b)
            spare = BANDS.spare[b]
            # Give up first what would have met: the units shared with the other set.
            whole = {(int(s), int(k)) for s, k in zip(segment[other & ~deletion], key[other & ~deletion])}
            units = [s for s in range(BANDS.segments[b]) if s >= spare and any((s, int(k)) in whole for k in key[mine & (segment == s) & ~deletion])]
            units += [s for s in range(spare) if any((s, int(k)) in whole for k in key[mine & (segment == s) & deletion])]
            given = set(units[:spare])
            probes = mine & np.array([not (s in given and (s >= spare or d)) for s, d in zip(segment.tolist(), deletion.tolist())])
            theirs = set(key[other].tolist())
            whole_keys = set(key[other & ~deletion].tolist())
            met = any(int(k) in (whole_keys if d else theirs) for k, d in zip(key[probes], deletion[probes]))
            assert met, (n, gone, most, b)


def test_every_size_takes_part_where_its_partners_do():
    for size in range(1, 3000):
        partners = range(-(-size * 90 // 100), size * 100 // 90 + 1)
        for other in partners:
            if 0 < other != size:
                assert set(BANDS.of(size)) & set(BANDS.of(other)), (size, other)


def family(rng, words, n, copies, most):
    base = rng.choices(words, k=n)
    out = [base]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randint(0, most)):
            text[rng.randrange(n)] = rng.choice(words)
        out.append(text)
    return out


@pytest.mark.parametrize("block", [8, 1024])
def test_families_chains_and_strangers(spark, block):
    """Families around the threshold, a chain of small steps, short texts, and one passage that many texts share."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    texts = family(rng, words, 150, 120, 6) + family(rng, words, 14, 40, 1) + family(rng, words, 60, 60, 3)
    link = rng.choices(words, k=100)
    for _ in range(25):
        texts.append(link)
        link = list(link)
        link[rng.randrange(100)] = rng.choice(words)
    passage = rng.choices(words, k=80)
    texts += [passage + rng.choices(words, k=rng.randint(0, 30)) for _ in range(60)]
    texts += [rng.choices(words[:3], k=rng.randint(0, 12)) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += rng.sample(rows, 20)
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), block=block) == brute(rows)


def test_documents_of_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs) == brute(rows)
    assert found(docs, percent=70, width=2) == brute(rows, 70, 2)
