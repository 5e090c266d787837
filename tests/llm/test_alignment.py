"""Cross-tokenizer alignment against a plain walk over the tokens."""

import hashlib
from collections import defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from calledzone.llm import alignment

BYTES, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def aligned(docs, **options):
    return alignment.align(docs, public_tokenizers.path(BYTES), public_tokenizers.PATTERN, public_tokenizers.path(PIECES), **options)


def byte_letters():
    """The printable letter of each byte, as byte-level vocabularies write it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in plain]
    return letters | {chr(256 + k): b for k, b in enumerate(others)}


def both_tokens():
    json_file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    json_file.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    letters = byte_letters()
    assert set(letters) == set(ByteLevel.alphabet())

    def side_a(text):
        ids = json_file.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(letters[c] for c in json_file.id_to_token(i))) for i in ids]

    def side_b(text):
        return [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i)
                 else pieces.id_to_piece(i).replace("▁", " ").encode()) for i in pieces.encode(text)]

    return side_a, side_b


def walk(text, side_a, side_b):
    """Tokens, groups and links of one text, byte by byte."""
    if not text:
        return None
    a, b = side_a(text), side_b(text)
    whole = b" " + text.encode()
    if b"".join(s for _, s in a) != whole or b"".join(s for _, s in b) != whole:
        return None
    owners = [[k for k, (_, s) in enumerate(side) for _ in s] for side in (a, b)]
    links = set(zip(*owners))
    ends = [{sum(len(s) for _, s in side[:k + 1]) for k in range(len(side))} for side in (a, b)]
    groups, last = [], 0
    for end in sorted(ends[0] & ends[1]):
        ids = [dict.fromkeys(side[k] for k in range(last, end)) for side in owners]
        groups.append("|".join(",".join(str(tokens[k][0]) for k in side) for side, tokens in zip(ids, (a, b))))
        last = end
    return a, b, groups, [(a[i][0], b[j][0]) for i, j in links]


def brute(rows):
    side_a, side_b = both_tokens()
    found = [(i, walk(text, side_a, side_b)) for i, text in rows]
    holders = defaultdict(int)
    for _, one in found:
        for pair in set(one[3]) if one else ():
            holders[pair] += 1
    most = defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    out = []
    for i, one in found:
        if not one:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = one
        out.append((i, len(a), len(b), len(groups), len(links), sum(holders[p] == most[p[0]] for p in links),
                    sum(holders[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


HARD = ["<|endoftext|> a", "</s> <unk> <0x0A>", "  lead", "a\n\n\n  b \t\r\n", "日本語 😀😀 ﬁ", "don't I'LL 1234567",
        "x" * 300, "\x00\x01 a", "▁ held", "é " * 40, "   ", "Straße Ǆ ﷺ"]


def test_alignment_equals_a_walk(spark, odd_docs, odd_rows):
    short = [(i, text) for i, text in odd_rows if len(text or "") < 10000]
    docs = odd_docs.filter("length(text) is null or length(text) < 10000")
    assert rows_of(aligned(docs)) == brute(short)
    hard = [*enumerate(HARD), (None, HARD[0]), (3, HARD[3])]
    frame = spark.createDataFrame(hard, "doc_id long, text string").repartition(3)
    assert rows_of(aligned(frame)) == brute(hard)
    # Many blocks give what one gives.
    assert rows_of(aligned(frame, block_bytes=1)) == brute(hard)


def test_alignment_of_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) < 3000")
    assert rows_of(aligned(docs, block_bytes=20000)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_of_nothing_and_of_a_long_text(spark, no_docs):
    assert aligned(no_docs).count() == 0
    text = " ".join(f"w{i % 977} {i}" for i in range(60000))
    row = aligned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_links == row.n_a + row.n_b - row.n_groups
    # Each pair stands in one document, so all of them are the commonest.
    assert row.count_sum == row.n_best == row.n_links > 100000
