"""Prefix trie against a plain one, and its query against SQL on the small table."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from calledzone.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = prefix_trie.COLUMNS


def plain_paths(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told = f"{len(role.encode())}:{role}{text}".encode()
            turns[conv].append((turn is not None, turn or 0, hashlib.sha256(told).digest()[:16], (role, text)))
    return {conv: tuple(t[3] for t in sorted(found)) for conv, found in turns.items()}


def plain_splice(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = paths.get(c - c % 5, ())[:h] + own[h:]
    return out


def plain_trie(paths):
    members = defaultdict(list)
    for conv, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        leaves, saved, open_ = 0, 0, [node]
        while open_:
            one = open_.pop()
            leaves += not children[one]
            saved += (len(members[one]) - 1) * (len(one[-1][1].encode()) if one else 0)
            open_ += children[one]
        return leaves, saved

    rows = []
    for node, convs in members.items():
        leaves, saved = below(node)
        ends = ",".join(str(c) for c in convs if paths[c] == node)
        rows.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children[node]),
                     leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def made_turns(seed, convs, hot=0.4, longest=40):
    """Conversations that share beginnings of many lengths, some equal, many with one first turn."""
    rng = random.Random(seed)
    known, rows = [[("user", "hello")]], []
    for conv in rng.sample(range(convs * 3), convs):
        kind = rng.random()
        start = known[0] if kind < hot else list(rng.choice(known)) if kind < 0.9 else []
        path = list(start[:rng.randint(0, len(start))]) if kind >= hot else list(start)
        path += [(rng.choice(["user", "assistant", "", None]), rng.choice(["a", "b", "é", "", None, f"t{conv}"]))
                 for _ in range(rng.choice([0, 0, 1, 2, 3, longest]))]
        path = path or [("user", "x")]
        known.append(path)
        rows += [(conv, k if k else None, role, text) for k, (role, text) in enumerate(path)]
    rng.shuffle(rows)
    return rows


ODD = [(1, 0, "user", "hi"), (1, 1, None, None), (2, 0, "user", "hi"), (2, 1, "", ""), (2, 1, "", ""), (3, None, "user", "hi"),
       (3, 0, "assistant", "x" * 100000), (None, 0, "user", "hi"), (4, 5, "user", "hi"), (4, 5, "user", "ho"), (11, 0, "a", "bc"),
       (12, 0, "ab", "c"), (13, 0, "日本", "😀"), (-7, 0, "user", "hi")]


@pytest.mark.parametrize("most_paths", [2, 4096])
def test_trie_equals_a_plain_one(spark, most_paths):
    for rows in (ODD, made_turns(3, 120, longest=5 if most_paths < 10 else 40)):
        turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
        for name in ("digest", "bytes", "n", "chain", "top"):
            turns = turns.withColumn(name, F.lit("clash"))
        convs = prefix_trie.conversations(turns)
        want = plain_paths(rows)
        assert rows_of(prefix_trie.build_trie(convs, most_paths)) == plain_trie(want)
    spliced = prefix_trie.splice(convs)
    assert rows_of(prefix_trie.build_trie(spliced, most_paths)) == plain_trie(plain_splice(want))


def test_a_long_conversation_and_its_beginnings(spark):
    """A path of 3,000 turns, logged again at every hundredth turn: as many members on one chain."""
    rows = [(conv, k, "user", f"turn {k}") for conv, n in enumerate(range(100, 3001, 100)) for k in range(n)]
    got = rows_of(prefix_trie.build_trie(prefix_trie.conversations(spark.createDataFrame(rows, SCHEMA))))
    sizes = [len(f"turn {k}") for k in range(3000)]
    members = [30 - (d - 1) // 100 if d else 30 for d in range(3001)]
    saved = [sum((members[u] - 1) * sizes[u - 1] for u in range(max(d, 1), 3001)) for d in range(3001)]
    want = []
    for d in range(3001):
        ends = str(d // 100 - 1) if d and d % 100 == 0 else ""
        want.append((30 - members[d], d, 30 - members[d - 1] if d else None, members[d], int(d < 3000), 1, saved[d],
                     hashlib.sha256(ends.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.build_trie(prefix_trie.splice(prefix_trie.conversations(empty))).count() == 0
    # Its base is absent and all its turns fall away: it ends at the root.
    assert zlib.crc32(b"1") % 9 > 0
    alone = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)
    got = rows_of(prefix_trie.build_trie(prefix_trie.splice(prefix_trie.conversations(alone))))
    assert got == plain_trie({1: ()}) and len(got) == 1


def test_query_equals_sql(spark, small):
    sql = queries.ORACLES["op12_prefix_trie"]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
        names = ", ".join(COLUMNS)
        want = sorted(con.execute(f"SELECT {names} FROM ({sql})").fetchall(), key=str)
        crc = con.execute(f"SELECT conv_id, {queries.CRC32} FROM (VALUES (0), (-7), (123456789)) v(conv_id)").fetchall()
    assert crc == [(c, zlib.crc32(str(c).encode())) for c in (0, -7, 123456789)]
    assert rows_of(queries.op12_prefix_trie(spark, small)) == want
