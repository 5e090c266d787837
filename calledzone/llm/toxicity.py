"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, scores by context window.

Lexicon entries are whole words and word beginnings that labelled toxic texts hold and others
hardly ever do. They lie in a trie. Each distinct word of a text becomes a Levenshtein automaton (bit vectors of
reached places, one for each number of edits), and is run through the trie; at a beginning any reached place accepts.
Two neighbouring characters swapped are one edit. Words are looked up less the punctuation around them, and less
all signs around them.
A word gives one hit: the entry with the fewest edits, an exact one before a misspelling.
A hit is worth the share of toxic texts among the labelled ones with such a hit; a misspelling, and a hit in
quotation marks next to a word of reporting, have shares of their own. Misspellings are judged by labelled texts without an
exact hit, and start from the toxic share of the whole sample, as most words near an entry are just other words.
A text's score joins its exact entries, its best misspelling and its quotation as independent evidence.

So that copies of a text do not pass for evidence, texts whose least shingle is the same teach once.

Learning uses at most TRAIN_ROWS labelled texts and LEXICON entries; both bound the model that is
sent to the tasks. Scores use the text alone.

Defined cases: null text counts as empty; a text without hits, empty ones included, scores the toxic share
among labelled texts without hits. Null ids are scored and count as not held out. Repeated rows score alike. Without
labels nothing is known: every score is 0. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .labelled import labelled_sample
from .near_dup import words_of
from .scratch import held_out, keep, map_arrow, slices, two_columns
from .words import WordHashes, shingle_sets

TRAIN_ROWS = 20_000
LEXICON = 2_000
LEAST_TEXTS, LEAST_SHARE = 4, 0.01
PRECISION = 0.9
THRESHOLD = 0.7
STEMS = range(4, 7)
WINDOW = 6
CLEAN_WORDS = 200_000
# Marks stripped from words, marks that quote, words that report speech.
EDGES = ".,;:!?()[]{}<>*_~^\"'`´“”„‚‘’«»‹›…¡¿|/\\-–—"
QUOTES = "\"“”„«»‹›‘’"
REPORTING = frozenset(
    "said says wrote quote quoted quoting called reads word words term phrase slur "
    "dit écrit mot cité sagte schrieb wort zitat dijo escribió palabra cita".split())
STEM = "*"


class Trie:
    """Lexicon entries by character; `search` intersects it with the Levenshtein automaton of a word."""

    def __init__(self, entries: list[str]):
        self.root: dict = {}
        for number, entry in enumerate(entries):
            node = self.root
            for char in entry.rstrip(STEM):
                node = node.setdefault(char, {})
            node[STEM if entry.endswith(STEM) else ""] = number

    @staticmethod
    def allowed(length: int) -> int:
        """Edits allowed to an entry of so many characters."""
        return 0 if length < 5 else 1 if length < 9 else 2

    def stems(self, word: str) -> list[tuple[int, int]]:
        node, found = self.root, []
        for char in word:
            node = node.get(char)
            if node is None:
                break
            if STEM in node:
                found.append((node[STEM], 0))
        return found

    def search(self, word: str, swaps: bool = False) -> list[tuple[int, int]]:
        """(entry, edits) of all whole words within reach of `word`, and of all beginnings within reach of one of its
        own; with `swaps` two neighbouring characters in the other order are one edit."""
        places: dict[str, int] = {}
        for i, char in enumerate(word):
            places[char] = places.get(char, 0) | 1 << i
        most, accept = self.allowed(len(word) + 1), 1 << len(word)
        found = []
        start = tuple((2 << e) - 1 for e in range(most + 1))
        stack = [(self.root, start, 0, (0,) * len(start), 0)]
        while stack:
            node, reached, depth, earlier, there = stack.pop()
            entry = node.get("")
            if entry is not None:
                edits = next((e for e, bits in enumerate(reached) if bits & accept), None)
                if edits is not None and edits <= self.allowed(depth):
                    found.append((entry, edits))
            entry = node.get(STEM)
            if entry is not None:
                edits = next((e for e, bits in enumerate(reached) if bits), None)
                if edits is not None and edits <= self.allowed(depth):
                    found.append((entry, edits))
            for char, child in node.items():
                if char in ("", STEM):
                    continue
                here = places.get(char, 0)
                after, less, less_before, less_earlier = [], 0, 0, 0
                for bits, old in zip(reached, earlier):
                    now = (bits & here) << 1 | less_before | less_before << 1 | less << 1
                    if swaps:
                        now |= ((less_earlier & here) << 1 & there) << 1
                    after.append(now)
                    less, less_before, less_earlier = now, bits, old
                if any(after):
                    stack.append((child, tuple(after), depth + 1, reached, here))
        return found


def strip(word: str) -> str:
    return word.strip(EDGES)


def forms(raw: str) -> set[str]:
    """The word less the punctuation around it, and less all that is no letter, digit or mark."""
    word = strip(raw)
    if not word or word[0].isalnum() and word[-1].isalnum():
        return {word}
    stay = [i for i, char in enumerate(word) if char.isalnum() or unicodedata.category(char)[0] == "M"]
    return {word, word[stay[0]:stay[-1] + 1]} if stay else {word}


class Finder:
    """Hits of texts; words without any are remembered up to a bound."""

    def __init__(self, entries: list[str]):
        self.trie = Trie(entries)
        self.exact = {entry for entry in entries if not entry.endswith(STEM)}
        # One edit leaves the first or the last two characters as they are, two edits one of three parts, or, if
        # characters are swapped across their borders, the first or the last part with the neighbour's character.
        short = [e for e in self.exact if Trie.allowed(len(e)) < 2]
        long = [e for e in self.exact if Trie.allowed(len(e)) == 2]
        self.heads, self.tails = {e[:2] for e in short}, {e[-2:] for e in short}
        self.short_lengths = {n for e in short for n in range(len(e) - 1, len(e) + 2)}
        self.long_lengths = {n for e in long for n in range(len(e) - 2, len(e) + 3)}
        parts = {part for e in long for k in (len(e) // 3,)
                 for part in (e[:k], e[k:2 * k], e[2 * k:], e[:k - 1] + e[k], e[2 * k - 1] + e[2 * k + 1:])}
        self.parts = re.compile("|".join(map(re.escape, sorted(parts))))
        stems = [e[:-1] for e in entries if e.endswith(STEM) and Trie.allowed(len(e) - 1)]
        self.stem_heads = {e[:2] for e in stems}
        self.stem_tails = {(at, e[-2:]) for e in stems for at in range(len(e) - 3, len(e))}
        self.stem_places = sorted({at for at, _ in self.stem_tails})
        self.clean: set[str] = set()

    def word(self, raw: str) -> list[tuple[int, int]]:
        found = []
        for word in forms(raw):
            found += self.trie.stems(word)
            size = len(word)
            if (size in self.short_lengths and (word[:2] in self.heads or word[-2:] in self.tails)
                    or size in self.long_lengths and self.parts.search(word)
                    or word[:2] in self.stem_heads
                    or any((at, word[at:at + 2]) in self.stem_tails for at in self.stem_places)):
                found += self.trie.search(word, swaps=True)
        best: dict[int, int] = {}
        for entry, edits in found:
            best[entry] = min(edits, best.get(entry, edits))
        return list(best.items())

    def text(self, text: str) -> list[tuple[int, str]]:
        """(entry, kind) of each word's best hit: exact, near (misspelled), quoted."""
        words = text.lower().split()
        suspects = {}
        for raw in set(words) - self.clean:
            hits = self.word(raw)
            if hits:
                suspects[raw] = min(hits, key=lambda hit: (hit[1], hit[0]))
            elif len(self.clean) < CLEAN_WORDS:
                self.clean.add(raw)
        if not suspects:
            return []
        out = []
        for at, raw in enumerate(words):
            if raw in suspects:
                entry, edits = suspects[raw]
                out.append((entry, "quoted" if quoted(words, at) else "near" if edits else "exact"))
        return out


def quoted(words: list[str], at: int) -> bool:
    """Whether the word stands in quotation marks, with a word of reporting in its window."""
    before, after = words[max(0, at - WINDOW):at], words[at + 1:at + 1 + WINDOW]
    opened = words[at][0] in QUOTES or any(w[0] in QUOTES and w[-1] not in QUOTES for w in before)
    closed = words[at].rstrip(".,;:!?")[-1:] in QUOTES or any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after)
    return opened and closed and any(strip(w) in REPORTING for w in before + after)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their least shingle."""
    memo = WordHashes()
    for batch in slices(batches):
        hashes, sizes = shingle_sets(words_of(batch.column("text").to_pylist()), 5, memo)
        starts = np.cumsum(sizes) - sizes
        marks = np.where(sizes > 0, np.append(hashes, 0)[np.minimum(starts, len(hashes))].view(np.int64), 0)
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("label"), pa.array(marks)],
                                         names=["text", "label", "mark"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts of each label that hold a term, summed within the slice."""
    for batch in slices(batches):
        seen = (Counter(), Counter())
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            words = {word for raw in set(text.lower().split()) for word in forms(raw)}
            seen[label].update(words)
            seen[label].update({word[:n] + STEM for word in words for n in STEMS if len(word) >= n})
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()),
             pa.array([seen[0][t] for t in terms], pa.int64())], names=["term", "toxic", "other"])


@dataclass(frozen=True)
class Model:
    """Entries, the worth of an exact hit of each, of a misspelling of each and of a quoted hit, and of no hit."""

    entries: list[str]
    exact: list[float]
    near: list[float]
    quoted: float
    none: float


def _worth(toxic: int, other: int, prior: float, weight: float = 1.2) -> float:
    return (toxic + prior * weight) / (toxic + other + weight)


def _pick(rows) -> list[tuple[str, int, int]]:
    """Shortest precise beginnings, and whole words that are not just one of many with such a beginning."""
    stems: dict[str, tuple[str, int, int]] = {}
    for row in sorted((r for r in rows if r.term.endswith(STEM)), key=lambda r: (len(r.term), r.term)):
        bare = row.term[:-1]
        short = next((bare[:n] for n in STEMS if n < len(bare) and bare[:n] in stems), None)
        if short is None:
            stems[bare] = (row.term, row.toxic, row.other)
        elif row.toxic >= 0.95 * stems[short][1] and row.other < stems[short][2]:
            del stems[short]  # the longer one finds as much with fewer mistakes
            stems[bare] = (row.term, row.toxic, row.other)
    words = {}
    for row in rows:
        stem = next((stems[row.term[:n]] for n in STEMS if row.term[:n] in stems), None)
        if not row.term.endswith(STEM) and row.term and (stem is None or 2 * row.toxic >= stem[1]):
            words[row.term] = (row.term, row.toxic, row.other)
    # A beginning of a single word is that word.
    whole = {w[:n] for w in words for n in STEMS}
    return list(words.values()) + [s for bare, s in stems.items() if bare not in whole]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn the lexicon and what hits are worth, in two passes over the sample."""
    marked = map_arrow(labelled_sample(docs, labels, "toxic", rows).select("text", "label"), _marked,
                       "text string, label int, mark long")
    sample = keep(marked.groupBy("mark", "label").agg(F.min("text").alias("text")), "sample")
    least = max(LEAST_TEXTS, int(LEAST_SHARE * sample.filter("label = 1").count()))
    terms = map_arrow(sample, _terms, "term string, toxic long, other long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    found = terms.filter((F.col("toxic") >= least) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("other"))))
    picked = _pick(found.orderBy(F.desc("toxic"), "term").limit(LEXICON * 5).collect())
    picked = sorted(picked, key=lambda e: (-e[1], e[0]))[:LEXICON]
    entries = [entry for entry, _, _ in picked]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(entries)
        for batch in slices(batches):
            out = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found = {(-1, kind) if kind == "quoted" else (entry, kind) for entry, kind in finder.text(text)}
                if any(kind == "exact" for _, kind in found):
                    found = {(entry, kind) for entry, kind in found if kind != "near"}
                out += [(label, entry, kind) for entry, kind in found or {(-1, "none")}]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["label", "entry", "kind"])

    counts = Counter()
    counted = map_arrow(sample, hits, "label long, entry long, kind string").groupBy("label", "entry", "kind").count()
    for row in counted.collect():  # at most four rows an entry, and four more
        counts[row.label, row.entry, row.kind] = row["count"]
    span = range(len(entries))
    told = [counts[label, -1, "quoted"] for label in (0, 1)]
    none = [counts[label, -1, "none"] for label in (0, 1)]
    texts = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    usual = texts.get(1, 0) / sum(texts.values()) if texts else 0.0
    return Model(
        entries, [_worth(toxic, other, 1.0) for _, toxic, other in picked],
        [_worth(counts[1, i, "near"], counts[0, i, "near"], usual) for i in span],
        _worth(told[1], told[0], 0.3), none[1] / sum(none) if sum(none) else 0.0)


def score_text(finder: Finder, model: Model, text: str) -> float:
    clear, near, told = 1.0 - model.none, 0.0, 0.0
    for entry, kind in set(finder.text(text)):
        if kind == "exact":
            clear *= 1.0 - model.exact[entry]
        elif kind == "near":
            near = max(near, model.near[entry])
        else:
            told = model.quoted
    return 1.0 - clear * (1.0 - near) * (1.0 - told)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.entries)
        for batch in slices(batches):
            scores = [score_text(finder, model, text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())],
                                             names=["doc_id", "score"])

    scored = map_arrow(two_columns(docs, id_col, text_col), run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` less the rejected ones, with all its columns."""
    lost = keep(score(docs, train(docs, labels)).filter("predicted = 1").select("doc_id").distinct(), "lost")
    return bloom.without(docs, "doc_id", lost, lost.count())
