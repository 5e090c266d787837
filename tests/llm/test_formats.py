"""SentencePiece against the library, packing and chat round trips, archives, the pipeline."""

import gzip
import hashlib
import random
from collections import defaultdict
from dataclasses import replace

import corpus_pipeline
import pytest
import sentencepiece
from pyspark.sql import functions as F
from calledzone.llm import chat, packing, queries, sentencepiece_bpe, warc
from calledzone.llm.scratch import new_folder

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encoder_is_the_library(library):
    model = sentencepiece_bpe.read_model(PATH)
    encoder, rng = sentencepiece_bpe.Encoder(model), random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "e", "th", "▁", "日本", "😀", "\x00", "<s>", "</s>", "==", "aaaa", "0x0A", "ﬁ", "é", "!!!",
             "The", " " * 40, "x" * 30, "\r\n", "unk", "�", "ß"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(1500)]
    texts += [" " * k + tail for k in range(90) for tail in ("", "a")] + [" " * 4001 + "b", "ab" * 2000]
    found, want = encoder.encode(texts), library.encode(texts)
    assert [ids.tolist() for ids in found] == want
    assert [sentencepiece_bpe.decode_ids(model, ids) for ids in want] == [library.decode(ids) for ids in want]


def test_round_trip_digests(odd_docs, odd_rows, no_docs, library):
    def row(i, text):
        ids = library.encode(text or "", add_eos=True)
        return (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest())

    got = sentencepiece_bpe.round_trip(odd_docs, PATH)
    assert sorted(map(tuple, got.collect())) == sorted(row(i, t) for i, t in odd_rows)
    assert sentencepiece_bpe.round_trip(no_docs, PATH).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(8)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    rows, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(room[r], r) for r in range(len(rows)) if room[r] >= sizes[i]]
        if fits:
            least = min(fits)[0]
            r = next(r for left, r in fits if left == least)
        else:
            r = len(rows)
            rows.append([])
            room.append(100)
        rows[r].append(i)
        room[r] -= sizes[i]
    got = packing.best_fit_decreasing(sizes, 100)
    assert sorted(i for row in got for i in row) == list(range(500))
    assert all(sum(sizes[i] for i in row) <= 100 for row in got)
    assert sorted(sum(sizes[i] for i in row) for row in got) == sorted(100 - left for left in room)


def test_packing_round_trip(odd_docs, odd_rows, no_docs, library):
    matrices = packing.pack_documents(odd_docs.filter("doc_id <> 7"), PATH)
    got = {r.doc_id: r.ids for r in packing.unpack(matrices).collect()}
    assert got == {i: library.encode(t or "", add_eos=True) for i, t in odd_rows if i != 7}
    for row in matrices.collect():
        assert len(row.ids) == 4 * row.n_rows * row.length and len(row.positions) == 2 * row.n_rows * row.length
        places = memoryview(bytes(row.positions)).cast("H")
        for k, (r, end) in enumerate(zip(row.seg_rows, row.seg_lengths)):
            start = row.seg_lengths[k - 1] if k and row.seg_rows[k - 1] == r else 0
            assert list(places[r * row.length + start:r * row.length + end]) == list(range(end - start))
    assert packing.pack_documents(no_docs, PATH).count() == 0


def told(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, these in turns.items():
        these.sort()
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in these)
        loss = "".join(text for *_, role, text in these if role == "assistant")
        out[conv] = (len(these), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(spark, rows):
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(turns)
    return windows, {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["<|", "<\\|", "\\", "|>", "<|end|>\n", "<|turn|>", "<", "é😀", "word ", "\n", "</turn>"]
    rows = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
            (None, 0, "user", "x"), (None, None, None, None), (1, 0, "system", "s" * 9000), (1, 1, "assistant", "y"), (2, 0, "system", "only"),
            (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 0, "user", "z" * 20000), (4, 1, "assistant", "w" * 9000)]
    for conv in range(10, 30):
        for turn in range(rng.randint(1, 30)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "to<|text|>ol"])
            rows.append((conv, turn, role, "".join(rng.choices(bits, k=rng.randint(0, 400)))))
    rows += [(50, turn, rng.choice(["user", "assistant"]), "word " * 40) for turn in range(700)]
    windows, got = read(spark, rows)
    assert got == told(rows)
    assert read(spark, rows[:0])[1] == {}


def test_chat_budget_and_history(spark):
    rows = [(1, 0, "system", "rules " * 20)] + [(1, t, ("user", "assistant")[t % 2], f"turn {t} " * 30) for t in range(1, 60)]
    windows = sorted(read(spark, rows)[0].collect(), key=lambda r: r.window)
    assert len(windows) > 3
    for n, row in enumerate(windows):
        turns = row.formatted.split(chat.END)[:-1]
        assert turns[0].startswith(chat.TURN + "system") and row.fresh[0] == (n == 0)
        tokens = sum(-(-len(t.split(chat.TEXT)[1].encode()) // 4) + 4 for t in turns)
        assert tokens <= chat.BUDGET
        targets = [row.formatted[m.start:m.start + m.length] for m in row.mask]
        assert targets == [t.split(chat.TEXT)[1] for t, f in zip(turns, row.fresh) if f and "assistant" in t.split(chat.TEXT)[0]]
    assert any(not f for row in windows[1:] for f in row.fresh[1:])


def test_archives(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 2000
    rows = [(1, "u", big), (2, "v", big), (3, None, None), (4, "a\r\nb", ""), (5, "u", "small"), (6, "u", "small"), (9, "z", big),
            (10, "q", "WARC/1.1\r\n\r\n"), (9, "z", big), (None, "n", "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", chat.F.lit("clash"))
    path = new_folder(spark, "warc-test")
    warc.write_archives(pages, path)
    captures = warc.assemble(warc.read_records(spark, path, with_payload=True)).collect()
    want = []
    for i, url, html in rows:
        raw = (html or "").encode()
        visit = 9 if html == big and i != 9 else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if visit else "response", visit))
    got = [(r.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.type, r.refers_to) for r in captures]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.request and r.metadata and (r.response.payload is None) == (r.response.type == "revisit") for r in captures)
    empty = new_folder(spark, "warc-test")
    warc.write_archives(pages.limit(0), empty)
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0


def test_archives_are_bounded_by_bytes(spark):
    """Many small pages, some of a megabyte and one larger than a file may be; clashing columns and repeated rows."""
    bound, rng = 1 << 20, random.Random(21)
    sizes = [rng.randint(0, 3000) for _ in range(400)] + [rng.randint(5000, 200_000) for _ in range(60)] + [1_000_000] * 3 + [3_000_000]
    rows = [(i, f"http://x/{i}" + "é" * rng.randint(0, 300), chr(97 + i % 26) * size) for i, size in enumerate(sizes)] + [(3, "http://x/3", "again")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for name in ("part", "digest", "keep_id", "bytes", "value", "__id", "__maybe"):
        pages = pages.withColumn(name, F.lit("clash"))
    path = new_folder(spark, "warc-test")
    warc.write_archives(pages, path, bound)
    files = [gzip.decompress(r.content) for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert all(len(data) <= bound or data.count(b"WARC-Type: response") <= 1 for data in files)
    assert len(files) < 3 * (sum(map(len, files)) // bound + 1) * 6
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    want = [(i, len(html.encode()), hashlib.sha1(html.encode()).hexdigest()) for i, _, html in rows]
    assert sorted((r.page_id, r.response.payload_bytes, r.response.payload_digest) for r in captures) == sorted(want)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [f(spark, docs, small).columns == docs.columns for _, f in corpus_pipeline.STAGES[:-1]] == [True] * 4
    rows = corpus_pipeline.run(spark, small).collect()
    ids = {r.doc_id for r in rows}
    assert len(ids) == len(rows) and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    texts = [r.text for r in docs.collect() if r.doc_id in ids]
    assert len(set(texts)) == len(texts)
    leaked = {r.doc_id for r in queries.op7_decontaminate(spark, small).collect()}
    rejected = {r.doc_id for r in queries.op8_toxicity(spark, small).collect() if r.predicted}
    assert not ids & leaked and not ids & rejected


def test_oracles_name_queries():
    assert set(queries.ORACLES) <= {q.__name__ for q in queries.QUERIES}


def test_pieces_take_two_bytes_an_id_on_their_way():
    """A vocabulary of 32k needs no more; larger ones take four."""
    import pyarrow as pa
    model = sentencepiece_bpe.read_model(PATH)
    texts = ["one two three", "", "the quick brown fox " * 1500]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([5, None, 9], pa.int64()), "text": texts})
    rows = [row for out in packing._pieces(model)(iter([batch])) for row in out.to_pylist()]
    encoder = sentencepiece_bpe.Encoder(model)
    lengths = [len(ids) + 1 for ids in encoder.encode(texts)]
    parts = [row for row in rows if row["matrix"] is None]
    assert [(row["doc_id"], row["piece"], len(row["tokens"])) for row in parts] == [
        (doc_id, n // packing.LENGTH, 2 * (n % packing.LENGTH)) for doc_id, n in zip((5, None, 9), lengths)]
    assert sum(row["matrix"]["n_rows"] for row in rows if row["matrix"]) == sum(n // packing.LENGTH for n in lengths) > 0
    assert packing.stored_ids(replace(model, vocabulary=70_000)) == "<u4"


def test_plain_texts_are_split_without_the_pattern(library):
    """Only runs of spaces need the pattern; both ways give the library's ids from one memory of words."""
    model = sentencepiece_bpe.read_model(PATH)
    encoder, whole = sentencepiece_bpe.Encoder(model), sentencepiece_bpe.Encoder(replace(model, cut_lines=False))
    plain = ["the quick\nbrown fox", "fox\n\nthe\tquick fox\nfox", "a▁b", "x"]
    runs = ["the  quick \n brown fox ", " fox\n   fox", "▁▁a \n", "fox \n", " ", "\n"]
    for one in (encoder, whole):
        assert [ids.tolist() for ids in one.encode(runs + plain)] == library.encode(runs + plain)
    encoder.pattern = None
    assert [ids.tolist() for ids in encoder.encode(plain)] == library.encode(plain)
