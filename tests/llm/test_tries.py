"""The prefix trie against dictionaries of prefixes, over several shards and levels of segments."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallymart.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(c - rest, [])[:h] + v[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in made.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids.get(k, 0), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
        for k, m in members.items()
    )


def made_rows(rng, n):
    words, rows = ["hé", "b", "c", "dd", ""], []
    for c in range(n):
        fixed = rng.random() < 0.3
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c * 2 - 30, t, "user" if t % 2 == 0 else "bot", words[0] if fixed else rng.choice(words)))
    rows += [(2, 0, "user", "b"), (2, 0, "user", "b"), (2, None, None, None), (3, None, "z", "x"), (3, None, "a", "y"), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("segment", [3, 4096])
def test_trie(spark, segment):
    rows = made_rows(random.Random(segment), 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(-1 if v is None else v for v in r) for r in tries.prefix_trie(df, segment).collect())
    assert got == brute(rows)


def test_copies_long_ones_and_nothing(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400) for t in range(10)]
    rows += [(1000, t, "user", f"turn {t}" if t < 40 else str(t % 7)) for t in range(300)] + [(1005, t, "user", f"turn {t}" if t < 40 else str(t % 6)) for t in range(290)]
    df = spark.createDataFrame(rows, SCHEMA)
    for segment in (64, 4096):
        assert sorted(tuple(-1 if v is None else v for v in r) for r in tries.prefix_trie(df, segment).collect()) == brute(rows)
    assert tries.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tries.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_turnless_conversations_belong_to_the_root(spark):
    few = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 9 > 1 and c % 5][:8]  # whose first one isn't there
    rows = [(c, 0, "user", "a") for c in few]
    got = tries.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(-1 if v is None else v for v in r) for r in got] == brute(rows)
    assert len(got) == 1 and got[0].n_leaves == 1 and got[0].n_convs == len(few)


def test_digest_in_chunks(spark, monkeypatch):
    rows = [(1, 2, c) for c in range(5000)] + [(1, 3, 7)]
    ends = spark.createDataFrame(rows, "q1 long, q2 long, conv long").repartition(3)
    got = {(r.p1, r.p2): r.ends_sha256 for r in tries.digests(ends).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(), (1, 3): hashlib.sha256(b"7").hexdigest()}


def test_trees_are_balanced():
    trie = tries.Trie()
    for i in tries.medians(1000):
        trie.insert([(i, 1)])
    deep, stack = 0, [(trie.down[0], 1)]
    while stack:
        v, d = stack.pop()
        deep = max(deep, d)
        stack += [(x, d + 1) for x in (trie.low[v], trie.high[v]) if x >= 0]
    assert deep == 10
