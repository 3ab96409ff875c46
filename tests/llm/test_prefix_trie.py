"""The z-fast trie and the prefix trie of conversations, held against plain versions."""

import hashlib
import random
import zlib

import pytest

from runsift.llm import prefix_trie as module
from runsift.llm.prefix_trie import prefix_trie
from runsift.llm.zfast import WIDTH, ZFastTrie, digest, fattest

SCHEMA = "conv_id long, turn long, role string, text string, id string, depth int, n long"


def chain(letters):
    out, before = [], b""
    for letter in letters:
        before = hashlib.blake2b(before + bytes([letter]), digest_size=WIDTH).digest()
        out.append(before)
    return b"".join(out)


def test_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            assert fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)


@pytest.mark.parametrize("seed", range(60))
def test_trie_has_the_ends_and_branches_of_its_sequences(seed):
    rng = random.Random(seed)
    letters = rng.choice([1, 2, 3])
    inside = list({tuple(rng.randrange(letters) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 60))})
    rng.shuffle(inside)
    trie = ZFastTrie(0)
    for s in inside:
        trie.insert(chain(s), None)
    follow = {}
    for s in inside:
        for d in range(len(s) + 1):
            follow.setdefault(s[:d], set()).update(s[d : d + 1])
    want = {chain(p)[-WIDTH:] for p in follow if p and (len(follow[p]) != 1 or p in inside)}
    got = [digest(x, deep) for x, deep in zip(trie.kept, trie.deep)]
    assert len(got) == len(set(got)) == len(trie.handles) == len(trie.names) and set(got) == want
    for _ in range(40):
        x = tuple(rng.randrange(letters) for _ in range(rng.randrange(1, 45)))
        node, depth = trie.exit(chain(x))
        assert depth == max(d for d in range(len(x) + 1) if x[:d] in follow)
        assert node is None or trie.top[node] < depth <= trie.deep[node]


def plain_trie(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        ends.setdefault(whole, []).append(c)
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        last = len(p[-1][1].encode()) if p else 0
        leaves, saved = (sum(below[k][0] for k in children[p]), sum(below[k][1] for k in children[p])) if p in children else (1, 0)
        below[p] = leaves, saved + (len(members[p]) - 1) * last
        listed = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), *below[p], hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(6)
    rows = []
    for c in range(120):
        base = random.Random(c // 5 // 3)  # families share their beginnings
        n = rng.choice([1, 2, 3, 5, 9, 14, 30])
        turns = [(base if t < 6 else rng).choice(["yes", "no", "größer", "", None]) for t in range(n)]
        rows += [(c, t, ["user", "assistant"][t % 2], text, "x", 1, 2) for t, text in enumerate(turns)]
    rows += [(c, 0, "user", "the same", "x", 1, 2) for c in range(500, 560)]  # copies
    rows += [(c, t, "u", "deep", "x", 1, 2) for c in range(600, 612) for t in range(c - 590)]  # a caterpillar
    rows += [(700, t, "u", f"t{t}", "x", 1, 2) for t in range(1500)] + [(703, t, "u", "long " * 30_000, "x", 1, 2) for t in range(2)]
    rows += [(13, None, "user", "first", "x", 1, 2), (13, None, None, None, "x", 1, 2), (13, 0, "b", "tie", "x", 1, 2), (13, 0, "a", "tie", "x", 1, 2)]
    rows += [(801, 0, "u", "alone", "x", 1, 2), (None, 0, "u", "lost", "x", 1, 2), (4_000_000_000, 0, "u", "far", "x", 1, 2)]
    return rows + rows[:20]


def got(frame):
    return sorted(map(tuple, prefix_trie(frame).collect()), key=repr)


def test_prefix_trie_is_the_plain_one(spark):
    rows = conversations()
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain_trie(rows)


def test_small_batches_give_the_same(spark, monkeypatch):
    # Samples of few sequences, so that groups go through several batches and tasks.
    monkeypatch.setattr(module, "SAMPLE", 4)
    monkeypatch.setattr(module, "SMALL", 30)
    rows = [r for r in conversations() if r[0] != 700]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain_trie(rows)


def test_few_and_none(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "u", "x", "", 0, 0)], SCHEMA)).count() == 0
    # Its one turn is left out, and there is no conversation 0.
    assert zlib.crc32(b"1") % 9 > 0
    rows = [(1, 0, "u", "gone", "", 0, 0)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain_trie(rows) and len(plain_trie(rows)) == 1
