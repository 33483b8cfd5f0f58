import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from vecloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string, n_bytes long, part int"


def table(spark, rows, parts=3):
    full = [(*r, 1, "n", 2, 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)


def plain(rows):
    """The trie as dicts of tuples."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        nb = len(path[-1][1].encode()) if path else 0
        saved[path] = (len(members[path]) - 1) * nb + sum(saved[x] for x in children[path])
    return sorted(
        (min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p)).encode()).hexdigest())
        for p, cs in members.items())


def got(spark, rows, **options):
    out = prefix_trie.prefix_trie(table(spark, rows), **options)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in out.collect())


def script(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(-6, n):
        if rng.random() < 0.1:
            continue
        common = rng.random() < 0.4  # many begin alike, or are alike as a whole
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, "user" if t % 2 else None, f"same {t}" if common else rng.choice(["a", "bb", "ü", "", None])))
    return rows


@pytest.mark.parametrize("options", [{}, {"unit": 6, "run": 3, "stretch": 2}])
def test_trie(spark, options):
    rows = script(1)
    assert got(spark, rows, **options) == plain(rows)


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, equal turns, missing base conversations, very long texts."""
    rows = [(None, 1, "a", "b"), (None, None, None, None), (7, None, "u", "first"), (7, 0, "u", "x"), (7, 0, "u", "x"), (7, 0, None, "y"),
            (8, 5, None, None), (8, -5, "", ""), (11, 1, "u", "long " * 200_000), (12, 1, "u", "long " * 200_000), (-3, 0, "u", "x"),
            (10, 0, "a", "bc"), (13, 0, "ab", "c"), (2**62, 0, "u", "x")] + [(20, t, "u", "x") for t in range(30)]
    assert got(spark, rows, unit=5) == plain(rows)
    assert got(spark, []) == [] and got(spark, [(None, 0, "u", "x")]) == []


def test_hot_conversation(spark):
    """A third of all rows in one conversation, half of them one repeated row, cut among all parts."""
    rows = [(10, 0, "u", "same")] * 400 + [(10, t, "u", f"t{t}") for t in range(1, 400)] + script(2)
    assert got(spark, rows, unit=30, run=5, stretch=16) == plain(rows)


def test_queue():
    rng = random.Random(3)
    queue, want = prefix_trie.SpillingQueue(limit=7), defaultdict(lambda: [0, 0])
    for _ in range(500):
        key, x, y = (rng.randrange(-9, 0), rng.randrange(5)), rng.randrange(9), rng.randrange(9)
        queue.push((*key, x, y))
        want[key][0] += x
        want[key][1] += y
    assert queue.n_runs > 10
    for key in sorted(want):
        assert list(queue.take(key)) == want[key]
    assert queue.take((0, 0)) == (0, 0)


def test_pieces(spark):
    """Ids of one node that make many pieces give the digest of the whole list."""
    rng = random.Random(4)
    ids = [rng.randrange(-10**9, 10**9) for _ in range(500)]
    paths = spark.createDataFrame([(bytes([i % 2]), c, 3, 3) for i, c in enumerate(dict.fromkeys(ids))], "node binary, conv_id long, depth long, length long")
    out = {bytes(r.node): r.ends_sha256 for r in prefix_trie.end_digests(paths.repartition(5), piece=20).collect()}
    for node in (0, 1):
        mine = sorted(c for i, c in enumerate(dict.fromkeys(ids)) if i % 2 == node)
        assert out[bytes([node])] == hashlib.sha256(",".join(map(str, mine)).encode()).hexdigest()
