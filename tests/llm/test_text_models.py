"""Toxicity, quality and decontamination: held-out accuracy, automata against edit distance, planted passages."""

import random
from collections import Counter

import numpy as np

from calledzone.llm import decontaminate, quality, queries, toxicity
from tests.llm.conftest import LOREM

SF = "/root/testdata/sf0.01"


def accuracy(spark, scored, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in scored.collect() if r.held_out and r.doc_id in labels]
    return sum(labels[r.doc_id] == r.predicted for r in rows) / len(rows)


def test_quality_held_out(spark, odd_docs, no_docs):
    assert accuracy(spark, queries.op4_quality(spark, SF), "quality") > 0.95
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (12, 0, 1), (12, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(odd_docs, labels)
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality.score(no_docs, model).count() == 0
    unknown = quality.train(odd_docs, labels.limit(0))
    assert {round(r.score, 1) for r in quality.score(odd_docs, unknown).collect()} == {0.5}


def all_features(text):
    """Buckets of every word, n-gram and pair of a text, by plain loops."""
    words, told, out = text.split(), [], []
    for at, word in enumerate(words):
        out += quality.features(word)
        before = [back for back in range(1, quality.BACK + 1) if back <= at and words[at - back] == word]
        told.append(quality.name_of(f"\x00{before[0]}" if before else word))
    for a, b in zip(told, told[1:]):
        a, b = (int(x) * int(m) for x, m in zip((a, b), quality.MULTIPLIERS))
        out.append(int(quality.mix(np.array([(a + b) % (1 << 64)], np.uint64))[0]) % quality.BUCKETS)
    return out


def test_quality_is_the_plain_forward_pass():
    """Scores of many texts at once against averaged vectors and a softmax of each text; the descent against a loop by feature."""
    rng = random.Random(12)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "a", "ü"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)] + ["", "one", "same same same", "x y x y x y"]
    labels = np.array([rng.randint(0, 1) for _ in texts])
    counted = [Counter(all_features(text)) for text in texts]
    places = [np.array(sorted(c), np.int64) for c in counted]
    counts = [np.array([c[p] for p in sorted(c)], np.int64) for c in counted]
    vectors, layer, bias = quality.descend(places, counts, labels)
    scorer = quality.Scorer(quality.fit(places, counts, labels))
    got = np.concatenate([scorer.score(texts[:17]), scorer.score(texts[17:])])
    for text, score in zip(texts, got):
        found = all_features(text)
        average = sum((vectors[f] for f in found), np.zeros(quality.WIDTH)) / max(1, len(found))
        odds = np.exp(layer @ average + bias)
        assert abs(odds[1] / odds.sum() - score) < 1e-9
    again = plain_descent(counted, labels)
    assert all(np.allclose(x, y, rtol=0, atol=1e-9) for x, y in zip((vectors, layer, bias), again))


def plain_descent(counted, labels, seed=7):
    rng = np.random.default_rng(seed)
    width = quality.WIDTH
    vectors = rng.uniform(-1 / width, 1 / width, (quality.BUCKETS, width))
    layer, bias, steps = np.zeros((2, width)), np.zeros(2), Counter()
    for epoch in range(quality.EPOCHS):
        rate = quality.RATE * (1 - epoch / quality.EPOCHS)
        for i in rng.permutation(len(labels)):
            total = max(1, sum(counted[i].values()))
            average = sum((vectors[f] * n / total for f, n in counted[i].items()), np.zeros(width))
            odds = np.exp(layer @ average + bias)
            error = odds / odds.sum() - np.eye(2)[labels[i]]
            back = error @ layer
            layer = layer - rate * 5 * np.outer(error, average)
            bias = bias - rate * 0.1 * error
            for f, n in counted[i].items():
                steps[f] += (np.abs(back).max() * n / total) ** 2
                vectors[f] -= rate * n / total / np.sqrt(1e-8 + steps[f]) * back
    return vectors, layer, bias


def test_quality_of_words_never_learned(spark):
    """Area under the curve on the held-out third at sf0.1, where low texts repeat words that no other text holds."""
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/labels.parquet").select("doc_id", "quality")
    rows = queries.op4_quality(spark, root).filter("held_out").join(labels, "doc_id").collect()
    low, high = (np.array([r.score for r in rows if r.quality == q]) for q in (0, 1))
    area = np.mean(low[:, None] < high[None, :]) + np.mean(low[:, None] == high[None, :]) / 2
    wrong = sum(r.predicted != r.quality for r in rows)
    print("area", round(area, 4), "wrong", wrong, "of", len(rows), "low ones lost", int((low >= 0.5).sum()), "of", len(low))
    assert area > 0.98 and wrong < 0.02 * len(rows)


def test_toxicity_held_out(spark, odd_docs, no_docs):
    assert accuracy(spark, queries.op8_toxicity(spark, SF), "toxic") > 0.95
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd_docs, labels)
    assert {r.score for r in toxicity.score(odd_docs, model).collect()} == {0.0}
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.drop_toxic(odd_docs, labels).count() == 13


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(1)
    entries = ["idiot", "pathetic", "worthless", "disgusting", "scum", "clown"]
    trie = toxicity.Trie(entries)
    for _ in range(2000):
        word = list(rng.choice(entries))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "o", "t"])
        word = "".join(word)
        most = trie.allowed(len(word) + 1)
        want = {(n, edit_distance(word, e)) for n, e in enumerate(entries)}
        want = {(n, d) for n, d in want if d <= min(trie.allowed(len(entries[n])), most)}
        assert set(trie.search(word)) == want


def test_quotation_is_not_abuse():
    model = toxicity.Model(["moron"], [0.99], [0.9], 0.3, 0.01)
    finder = toxicity.Finder(model.entries)
    assert toxicity.score_text(finder, model, "you are a moron, really") > 0.9
    assert toxicity.score_text(finder, model, "you are a mor0n, really") > 0.85
    assert toxicity.score_text(finder, model, 'she said the word "moron" in her essay') < 0.5
    assert toxicity.score_text(finder, model, "") == model.none or abs(toxicity.score_text(finder, model, "") - 0.01) < 1e-9


def test_misspellings_do_not_add_up():
    model = toxicity.Model(["achlicher", "achlichber", "achlichver"], [0.95] * 3, [0.5, 0.5, 0.5], 0.3, 0.01)
    finder = toxicity.Finder(model.entries)
    assert toxicity.score_text(finder, model, "achlichxer und achlichbex und achlichvxr") < 0.6
    assert finder.text("achlichver") == [(2, "exact")]


def swap_distance(a, b):
    """Edits from a to b, two neighbouring characters swapped being one, by the whole table."""
    rows = [[max(i, j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if min(i, j) > 1 and a[i - 2:i] == b[j - 2:j][::-1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def test_finder_is_swap_distance():
    """Swaps, misspelled beginnings and signs around words, against the distance to every entry."""
    rng = random.Random(3)
    entries = ["idiot", "worthless", "disgusting", "scum", "clown", "réeuxa*", "bocoo*", "clownish"]
    finder = toxicity.Finder(entries)
    for _ in range(3000):
        entry = rng.choice(entries)
        word = list(entry.rstrip("*"))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(word))
            if rng.random() < 0.5:
                word[at:at + 2] = word[at:at + 2][::-1]
            else:
                word[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "o", "t"])
        word = "".join(word) + (rng.choice(["", "xyz", "o"]) if entry.endswith("*") else "")
        want = set()
        for n, e in enumerate(entries):
            ends = range(len(word) + 1) if e.endswith("*") else (len(word),)
            edits = min(swap_distance(e.rstrip("*"), word[:end]) for end in ends)
            if edits <= min(finder.trie.allowed(len(e.rstrip("*"))), finder.trie.allowed(len(word) + 1)):
                want.add((n, edits))
        assert set(finder.word("#" + word + "$$$")) == want, word
    assert finder.word("idoit") == [(0, 1)] and finder.word("clown###") == [(4, 0)] and finder.word("reeuxaux") == [(5, 1)]


def test_toxicity_by_language(spark):
    """Held-out precision and recall at sf0.1; words near an entry alone do not reject texts."""
    root = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{root}/{name}.parquet") for name in ("documents", "labels"))
    scored = queries.op8_toxicity(spark, root).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    counts = Counter((r.lang, r.toxic, r.predicted) for r in scored.join(labels, "doc_id").collect())
    for lang in ("de", "en", "es", "fr"):
        hit, lost, wrong = counts[lang, 1, 1], counts[lang, 1, 0], counts[lang, 0, 1]
        print(lang, "precision", hit, "of", hit + wrong, "recall", hit, "of", hit + lost, "clean", wrong + counts[lang, 0, 0])
        assert hit >= 0.9 * (hit + lost) and wrong <= 0.05 * (wrong + counts[lang, 0, 0])


def test_leaks_with_substitutions(spark, odd_docs, no_docs):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([30, 20, 7, 3, 40])] + [(None, None), (9, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    plain = [rng.choices(words, k=80) for _ in range(6)]

    def placed(i, edit=None, case=str):
        item = items[i][1].split()
        for at in edit or ():
            item[at] = "zzz"
        return " ".join(plain[0][:20] + [case(w) for w in item] + plain[1][:20])

    rows = [(1, placed(0)), (2, placed(0, edit=(2, 9, 16, 23))), (3, placed(1, case=str.upper)), (4, placed(2)), (5, placed(3)),
            (6, " ".join(plain[2])), (7, None), (8, ""), (9, placed(4, edit=range(0, 40, 3))), (1, placed(0)), (None, placed(0)),
            (10, " ".join(items[4][1].split()[10:24])), (11, placed(2, edit=(3,)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert got == {(1, 0), (2, 0), (3, 1), (4, 2), (10, 4)}
    assert decontaminate.find_leaks(no_docs, benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    extra = odd_docs.limit(20)
    assert decontaminate.drop_leaks(extra, spark.createDataFrame([(1, LOREM)], "item_id long, text string")).count() == 10


def agreeing(words, item, span=12, need=10):
    """Whether some aligned stretch of `span` tokens agrees in `need` of them, by trying all."""
    return any(sum(words[a + k] == item[b + k] for k in range(span)) >= need
               for a in range(len(words) - span + 1) for b in range(len(item) - span + 1))


def test_leaks_match_brute_force(spark):
    """Passages of 12 to 60 tokens, whole or a piece of an item, with tokens substituted at random or every fifth one."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(300)]
    items = [rng.choices(words, k=rng.randint(12, 60)) for _ in range(25)]
    texts = []
    for n in range(400):
        passage = list(items[n % 25])
        size = rng.randint(12, len(passage))
        begin = rng.randint(0, len(passage) - size)
        passage = passage[begin:begin + size]
        share = (0.1, 0.15, 0.3, 0)[n % 4]
        passage = ["zzz" if rng.random() < share or not share and k % 5 == n // 4 % 5 else w for k, w in enumerate(passage)]
        texts.append(rng.choices(words, k=10) + passage + rng.choices(words, k=10))
    for at in (0, 11):
        texts.append(rng.choices(words, k=10) + items[0][:at] + ["zzz"] + items[0][at + 1:12] + rng.choices(words, k=10))
    want = {(d, i) for d, text in enumerate(texts) for i, item in enumerate(items) if agreeing(text, item)}
    docs, benchmark = (spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(x)], f"{name} long, text string")
                       for x, name in ((texts, "doc_id"), (items, "item_id")))
    assert {(400, 0), (401, 0)} <= want
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs.repartition(4), benchmark).collect()} == want


def test_leaks_of_items_that_share_a_passage(spark):
    """A quote from the inside of a passage that items share is a leak of all, those of the same tokens and without an id too."""
    words = [f"v{i}" for i in range(100)]
    items = [(1, " ".join(["one"] + words[:50])), (2, " ".join(words[:50] + ["two"])), (3, " ".join(["ONE"] + words[:50])), (4, "x y z"),
             (2, " ".join(words[:50] + ["two"])), (None, " ".join(words[:50]))]
    docs = spark.createDataFrame([(7, " ".join(["q"] + words[3:45] + ["q"]))], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.item_id, r.first_token, r.last_token, r.matched) for r in found.collect()), key=str)
    assert got == [(1, 0, 44, 12), (2, 0, 44, 12), (3, 0, 44, 12), (None, 0, 44, 12)]


def test_leaks_of_shortest_items(spark):
    """Items of one to four tokens match as whole token sequences, unless too many documents hold them."""
    rng = random.Random(13)
    words = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=1 + i % 4))) for i in range(40)] + [(40, "..."), (41, "")]
    texts = [rng.choices(words, k=rng.randint(0, 40)) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for common in (0.0, 0.05, 0.5, 1.0):
        want = set()
        for item_id, text in items[:40]:
            item = text.split()
            held = {d for d, t in enumerate(texts) if any(t[k:k + len(item)] == item for k in range(len(t) - len(item) + 1))}
            want |= {(d, item_id) for d in held if len(held) <= int(common * len(texts))}
        got = decontaminate.find_leaks(docs, benchmark, common=common).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want), common


def test_leaks_of_short_items(spark):
    """One substitution at any place of 8 to 11 tokens, and characters as tokens in scripts without spaces."""
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(8, 12)] + [(20, "東京都は日本の首都です。")]
    rows, want = [], set()
    for n, text in items[:4]:
        for lost in [(k,) for k in range(n)] + [(0, n - 1)]:
            words = ["zzz" if k in lost else w for k, w in enumerate(text.split())]
            rows.append((len(rows), " ".join(["a"] + words + ["b"])))
            want |= {(len(rows) - 1, n)} if len(lost) == 1 else set()
    rows.append((1000, "昨日、東京都は日本の首都ですと聞いた"))
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()} == want | {(1000, 20)}


def test_leaks_on_documents(spark):
    """Every document that shares eight tokens in a row with an item is found, and no other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = set()
    for row in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = decontaminate.tokens_of([row.text])[0]
        seen |= {tuple(words[k:k + 12]) for k in range(len(words) - 11)}
    want = set()
    for row in docs.collect():
        words = decontaminate.tokens_of([row.text or ""])[0]
        if any(tuple(words[k:k + 12]) in seen for k in range(len(words) - 11)):
            want.add(row.doc_id)
    assert {r.doc_id for r in queries.op7_decontaminate(spark, SF).collect()} == want
