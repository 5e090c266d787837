"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The library only reads the model file: pieces, scores and kinds, on the driver, from where these
bounded tables go to the tasks. A batch's new words lie in flat numpy symbol arrays. Each round looks up all
adjacent pairs, takes the best pair rank of every word (a segmented minimum), merges all its occurrences from
the left at once, and compacts the arrays; words without a pair left drop out. Where a merge could
create a pair that ranks better than its own, only the leftmost one is made in that round, which keeps the
library's order exactly. Words are remembered across batches up to a bound.

The model must have BPE pieces, byte fallback, the identity normaliser and a space put in front of the text
(`read_model` refuses others). Pieces may hold the space mark at their start, or nothing else.

Defined cases: null text counts as empty; empty text gives the end id alone and decodes to empty text. Null id lists
decode to empty text. Rows are independent: repeated rows, null ids and empty tables need no care, and
other columns are kept by `encode` and `decode` unless they bear the name of the new column, which is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import map_arrow, slices

SPACE = "▁"
NO_RANK = np.int32(2**31 - 1)
REMEMBERED = 250_000
TABLE_BITS = 19
# Text encoded at once; words and symbol arrays take many times as much.
ENCODED_BYTES = 1 << 20


@dataclass(frozen=True)
class Model:
    """Lookup tables of a model; all are bounded by its vocabulary."""

    chars: dict[str, int]
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    pair_ranks: np.ndarray
    probes: int
    one_at_a_time: np.ndarray
    surfaces: list[bytes]
    base: int
    vocabulary: int
    end_id: int
    cut_lines: bool


def read_model(path: str) -> Model:
    """Tables of the model file at `path`."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    size = lib.get_piece_size()
    pieces = [lib.id_to_piece(i) for i in range(size)]
    special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
    if not any(map(lib.is_byte, range(size))) or any(map(lib.is_unused, range(size))):
        raise ValueError("the model needs byte fallback and no unused pieces")
    if lib.decode(lib.encode(" ﬁ  a ")) != " ﬁ  a " or lib.encode("a", out_type=str)[0][0] != SPACE:
        raise ValueError("the model needs the identity normaliser and a space in front")
    ids = {piece: i for i, piece in enumerate(pieces) if not special[i]}
    inner = [p for p in ids if SPACE in p[1:] and p.strip(SPACE)]
    if inner:
        raise ValueError("pieces may hold the space mark at their start only")
    scores = np.array([lib.get_score(i) for i in range(size)])
    ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
    # Characters that occur in pieces only get ids past the vocabulary, and end as bytes.
    chars = {p: i for p, i in ids.items() if len(p) == 1}
    for piece in ids:
        for char in piece:
            chars.setdefault(char, size + len(chars))
    symbol = ids | chars
    base = size + len(chars) + 1
    pairs, unsafe = {}, np.zeros(base, bool)
    for piece, i in ids.items():
        for k in range(1, len(piece)):
            left, right = symbol.get(piece[:k]), symbol.get(piece[k:])
            if left is None or right is None:
                continue
            pairs[left * base + right] = i
            for half in (left, right):
                if half < size and ranks[half] >= ranks[i]:
                    unsafe[half] = True
    keys = np.array(sorted(pairs), np.int64)
    merged = np.array([pairs[k] for k in keys.tolist()], np.int32)
    byte_ids = np.zeros(256, np.int32)
    surfaces = []
    for i, piece in enumerate(pieces):
        if lib.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surfaces.append(bytes([int(piece[3:5], 16)]))
        elif lib.is_control(i):
            surfaces.append(b"")
        elif lib.is_unknown(i):
            surfaces.append(" ⁇ ".encode())
        else:
            surfaces.append(piece.replace(SPACE, " ").encode())
    slots, probes = pair_table(keys)
    filled = slots >= 0
    return Model(chars, byte_ids, np.where(filled, keys[slots], -1), np.where(filled, merged[slots], 0),
                 np.where(filled, ranks[merged][slots], NO_RANK), probes, unsafe, surfaces, base, size, lib.eos_id(),
                 not any("\n" in p for p in ids))


def pair_slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def pair_table(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Hash table with linear probing: the index into `keys` held by each slot, and the longest search."""
    slots, waiting, probes = np.full(1 << TABLE_BITS, -1), np.arange(len(keys)), 0
    while len(waiting):
        place = (pair_slot(keys[waiting]) + probes) % len(slots)
        free = slots[place] < 0
        slots[place[free]] = waiting[free]
        waiting = waiting[slots[place] != waiting]
        probes += 1
    return slots, probes


class Encoder:
    """Encodes words in merge rounds and remembers them."""

    def __init__(self, model: Model):
        self.model = model
        self.char_ids = np.full(0x110000, -1, np.int32)
        for char, i in model.chars.items():
            self.char_ids[ord(char)] = i
        # Stretches no merge crosses: a run of spaces with the word behind it, and a line end with what follows at once.
        self.pattern = re.compile(r"\n[^ \n]*| *[^ \n]+| +" if model.cut_lines else " *[^ ]+| +")
        self.known: dict[str, bytes] = {}
        # Long runs of spaces are cut to their ends if each further `run` spaces just add its one piece in front.
        longest = max((len(s) for s in model.surfaces if s and not s.strip(b" ")), default=1)
        self.run, self.run_ids = 0, b""
        if longest > 1:
            piece = np.int32(model.surfaces.index(b" " * longest)).tobytes()
            sample = [SPACE * k for k in range(longest, 5 * longest)]
            found = dict(zip(sample, self._encode_words(sample)))
            if all(found[w] == piece + found[w[longest:]] for w in sample[2 * longest:]):
                self.run, self.run_ids = longest, piece

    def words(self, text: str) -> list[str]:
        """Stretches no merge crosses, each without the one space in front that all but line ends have."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if self.model.cut_lines:
            text = text.replace("\n", " \n")
        words = text.split(" ")
        if "" not in words:
            return words
        # Runs of spaces: the blank put before a line end above is no space.
        text = " " + (text.replace(" \n", "\n") if self.model.cut_lines else text)
        return [word[1:] if word[0] == " " else word for word in self.pattern.findall(text)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        split, known = [self.words(text) for text in texts], self.known
        found = [list(map(known.get, words)) for words in split]
        missed = [i for i, ids in enumerate(found) if None in ids]
        new = list({word for i in missed for word, ids in zip(split[i], found[i]) if ids is None})
        if new:
            known.update(zip(new, self._encode_stretches(new)))
            for i in missed:
                found[i] = map(known.__getitem__, split[i])
        out = [np.frombuffer(b"".join(ids), np.int32) for ids in found]
        if len(known) > REMEMBERED:
            # What was seen first stays: it holds the frequent words.
            for word in new:
                del known[word]
        return out

    def _encode_stretches(self, words: list[str]) -> list[bytes]:
        """Ids of each of `words`, as `words()` gives them."""
        if not self.model.cut_lines:
            return self._encode_words([SPACE + word.replace(" ", SPACE) for word in words])
        ends = [word[:1] == "\n" for word in words]
        out = self._encode_words([word[1:] if end else SPACE + word.replace(" ", SPACE) for end, word in zip(ends, words)])
        if any(ends):
            line_end, = self._encode_words(["\n"])
            out = [line_end + ids if end else ids for end, ids in zip(ends, out)]
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        heads, step, joined = [0] * len(words), self.run, "".join(words)
        if step and SPACE * (4 * step) in joined:
            for i, word in enumerate(words):
                if word.startswith(SPACE * (4 * step)):
                    run = len(word) - len(word.lstrip(SPACE))
                    heads[i] = (run - 3 * step) // step
            if any(heads):
                words = [word[step * head:] for word, head in zip(words, heads)]
                joined = "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        symbols = self.char_ids[codes]
        ids, owner = self._merge(symbols, codes, np.repeat(np.arange(len(words)), lengths))
        ends = np.cumsum(np.bincount(owner, minlength=len(words))) * 4
        raw, out, start = ids.astype(np.int32).tobytes(), [], 0
        for end in ends.tolist():
            out.append(raw[start:end])
            start = end
        if any(heads):
            out = [self.run_ids * head + ids for head, ids in zip(heads, out)]
        return out

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each pair, or an empty slot."""
        model = self.model
        place = pair_slot(keys)
        held = model.pair_keys[place]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        for _ in range(1, model.probes):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & ((1 << TABLE_BITS) - 1)
            held = model.pair_keys[place[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return place

    def _merge(self, symbols: np.ndarray, codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        model = self.model
        # An unknown character keeps its code point, negated, until it becomes bytes.
        symbols = np.where(symbols < 0, -1 - codes.astype(np.int64), symbols.astype(np.int64))
        done_symbols, done_place, done_owner = [], [], []
        place = np.arange(len(symbols))
        while len(symbols):
            key = symbols[:-1] * model.base + symbols[1:]
            at = self._find(key)
            hit = (model.pair_keys[at] == key) & (owner[:-1] == owner[1:]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)
            rank = np.append(np.where(hit, model.pair_ranks[at], NO_RANK), NO_RANK)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(first, len(symbols)))
            best = np.minimum.reduceat(rank, first)
            active = np.repeat(best < NO_RANK, sizes)
            if not active.all():
                idle = ~active
                done_symbols.append(symbols[idle])
                done_place.append(place[idle])
                done_owner.append(owner[idle])
            chosen = (rank == np.repeat(best, sizes)) & active
            at = np.append(at, 0)
            spots = np.flatnonzero(chosen)
            if len(spots):
                # Within a run of overlapping candidates every other one is made, from the left.
                breaks = np.flatnonzero(np.concatenate([[True], np.diff(spots) != 1]))
                in_run = np.arange(len(spots)) - np.repeat(breaks, np.diff(np.append(breaks, len(spots))))
                take = in_run % 2 == 0
                new = model.pair_ids[at[spots]]
                leftmost = np.concatenate([[True], owner[spots][1:] != owner[spots][:-1]])
                take &= leftmost | ~model.one_at_a_time[new]
                spots, new = spots[take], new[take]
                symbols[spots] = new
                gone = np.zeros(len(symbols), bool)
                gone[spots + 1] = True
                stay = active & ~gone
            else:
                stay = active
            symbols, owner, place = symbols[stay], owner[stay], place[stay]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(np.concatenate(done_place), kind="stable")
        symbols, owner = symbols[order], owner[order]
        return self._to_bytes(symbols, owner)

    def _to_bytes(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary become the ids of their UTF-8 bytes."""
        model = self.model
        odd = (symbols < 0) | (symbols >= model.vocabulary)
        if not odd.any():
            return symbols, owner
        late = {i: c for c, i in model.chars.items() if i >= model.vocabulary}
        texts = [(chr(-1 - s) if s < 0 else late[s]).encode() for s in symbols[odd].tolist()]
        widths = np.ones(len(symbols), np.int64)
        widths[odd] = list(map(len, texts))
        out = np.repeat(symbols, widths)
        out[np.repeat(odd, widths)] = model.byte_ids[np.frombuffer(b"".join(texts), np.uint8)]
        return out, np.repeat(owner, widths)


def decode_ids(model: Model, ids: list[int]) -> str:
    """Text of `ids`: bytes put together, the space in front taken off, broken UTF-8 replaced."""
    raw = b"".join(map(model.surfaces.__getitem__, ids))
    return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def _with_column(schema, name: str, kind: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != name]
    return ", ".join([*fields, f"`{name}` {kind}"])


def encode(docs: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`docs` with the ids of each whole text, the end id last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in slices(batches, text_col, ENCODED_BYTES):
            found = encoder.encode([text or "" for text in batch.column(text_col).to_pylist()])
            sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
            ends = np.cumsum(sizes)
            flat = np.empty(int(ends[-1]), np.int32)
            flat[ends - 1] = model.end_id
            body = np.ones(len(flat), bool)
            body[ends - 1] = False
            flat[body] = np.concatenate(found)
            column = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))
            names = [n for n in batch.schema.names if n != ids_col]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], column], names=[*names, ids_col])

    return map_arrow(docs, run, _with_column(docs.schema, ids_col, "array<int>"))


def decode(docs: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`docs` with the text that the ids stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [decode_ids(model, ids or []) for ids in batch.column(ids_col).to_pylist()]
                names = [n for n in batch.schema.names if n != text_col]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, text_col])

    return map_arrow(docs, run, _with_column(docs.schema, text_col, "string"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of ids, digests of the ids and of the text they decode to, in one pass over the texts."""
    model = read_model(path)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        numbers = [str(i) for i in range(model.vocabulary)]
        for batch in slices(batches, "text", ENCODED_BYTES):
            found = encoder.encode([text or "" for text in batch.column("text").to_pylist()])
            ids = [[*part.tolist(), model.end_id] for part in found]
            told = [hashlib.sha256(" ".join(map(numbers.__getitem__, part)).encode()).hexdigest() for part in ids]
            read = [hashlib.sha256(decode_ids(model, part).encode()).hexdigest() for part in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(told), pa.array(read)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return map_arrow(texts, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
