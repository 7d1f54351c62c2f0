"""Operator 13 against SQL and a trie of dictionaries, with containers that burst and odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest

from auditloom.llm import prefix_trie

SF = "/root/testdata/sf0.001"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _sql(view: str) -> list[str]:
    con = duckdb.connect()
    con.execute(f"create view conversations as {view}")
    cursor = con.execute(prefix_trie.OP13_SQL)
    assert [d[0] for d in cursor.description] == NAMES
    return sorted(map(repr, cursor.fetchall()))


def _found(df) -> list[str]:
    return sorted(repr(tuple(r)) for r in df.select(*NAMES).collect())


def _plain(rows) -> list[str]:
    """The nodes by dictionaries of prefixes."""
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - abs(c) % 5 * (1 if c > 0 else -1), [])[:h] + turns[h:]
    members: dict[tuple, list[int]] = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    kids: dict[tuple, int] = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p)))).encode()).hexdigest()
    return sorted(repr((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], ends(p))) for p, m in members.items())


def test_query_equals_sql(spark):
    found = _found(prefix_trie.op13_prefix_trie(spark, SF))
    assert found == _sql(f"select * from '{SF}/conversations.parquet'") and len(found) > 20


@pytest.fixture(scope="module")
def odd():
    rng, rows = random.Random(3), []
    for c in range(-8, 120):
        if c % 11 == 3:
            continue
        turns = [("u", "hello"), ("a", "xxx")] * rng.choice([0, 1, 1, 6]) + [(rng.choice(["u", None, "a"]), rng.choice(["a", "b", None, "é"])) for _ in range(rng.choice([1, 2, 3, 12, 14]))]
        rows += [(c, rng.choice([i, i, i, None, 3]), role, text) for i, (role, text) in enumerate(turns)]
    return rows + rows[:7] + [(None, 1, "u", "x")]


@pytest.mark.parametrize("container", [5, 40, 1_000_000])
def test_bursts_equal_sql_and_a_plain_trie(spark, odd, container, tmp_path):
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n", "2 as seq", "3 as depth")
    found = _found(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(df)), container))
    assert found == _plain(odd)
    if container == 5:
        df.drop("n", "seq", "depth").write.parquet(str(tmp_path / "c"))
        assert found == _sql(f"select * from '{tmp_path}/c/*.parquet'")


def test_long_shared_beginnings_and_chains(spark):
    """Copies, and a chain in which each conversation is a beginning of the next."""
    rows = [(1000 + c, t, "u", f"t{t}") for c in range(60) for t in range(c % 30 + 9)]
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))), 20)
    assert _found(found) == _plain(rows)


def test_digests_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    convs = spark.range(-50, 1000).selectExpr("id as conv_id", "if(id % 3 = 0, x'00', x'11') as seq")
    found = sorted(r.ends_sha256 for r in prefix_trie.end_digests(convs).collect())
    want = [hashlib.sha256(",".join(str(i) for i in range(-50, 1000) if (i % 3 == 0) == k).encode()).hexdigest() for k in (True, False)]
    assert found == sorted(want)


def test_no_conversations(spark):
    df = spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(df))).collect() == []
