import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.llm import exact_dedup, mixing, sharding, token_files
from vecloom.llm.queries import tokenizer_path

GAP = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("width", [64, 1])
def test_exact_dedup(make, odd, width):
    """Also with a digest of one hex digit, under which different texts meet all the time."""
    rows = odd + [(100 + i, f"text {i % 40}") for i in range(200)]
    got = exact_dedup.exact_dedup(make(rows), digest=lambda c: F.substring(F.sha2(c, 256), 1, width)).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[GAP.sub(" ", r[1] or "")].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i is not None and i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    assert exact_dedup.exact_dedup(make([])).collect() == []


def test_fill_table_is_even_and_stable():
    names = sharding.names_of(10)
    full = sharding.fill_table(names, 1009)
    sizes = Counter(full)
    assert set(sizes) == set(range(10)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(full, fewer) if a != 9)
    assert moved < 0.15 * 1009
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)


def test_assign_shards(make, odd):
    got = sharding.assign_shards(make(odd), sharding.names_of(4), 101).collect()
    assert len(got) == len(odd)
    table = sharding.fill_table(sharding.names_of(4), 101)
    for r in got:
        key = "null" if r.doc_id is None else f"={r.doc_id}"
        slot = int(hashlib.md5(key.encode()).hexdigest()[:12], 16) % 101
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.assign_shards(make([]), ["one"], 2).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=600))
def test_boundaries(lengths):
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    b = token_files.Boundaries.encode(offsets)
    assert (b.offsets() == offsets).all()
    for i in range(0, len(offsets), 7):
        assert b.offset(i) == offsets[i]


def test_boundaries_are_small():
    b = token_files.Boundaries.encode(np.arange(10_001) * 700)
    size = b.low_bytes.nbytes + b.high_bytes.nbytes + b.samples.nbytes
    assert size < 10_000 * 13 / 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab 1.'\n\t \x1cé", max_size=40), max_size=5))
def test_pieces_encode_like_whole_texts(texts):
    coder = token_files.Encoder(tokenizer_path())
    ids, lengths = coder.encode(texts)
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []
    assert ids.tolist() == [i for w in want for i in w] and lengths.tolist() == [len(w) for w in want]


def test_token_files(spark, make, odd, tmp_path):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(tokenizer_path())
    path = str(tmp_path / "files")
    token_files.write_token_files(make(odd), path, tokenizer_path(), ids_per_file=50)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    at = 0
    rows = sorted(odd, key=lambda r: -1 if r[0] is None else r[0])
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for g, r in zip(got, rows):
        ids = coder.encode(r[1] or "", add_special_tokens=False).ids + [0]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    files = spark.read.parquet(path).orderBy("part", "seq").collect()
    assert len(files) > 3
    one = token_files.documents_of(bytes(files[0].data), [0])[0].tolist()
    assert one == coder.encode(rows[0][1] or "", add_special_tokens=False).ids + [0]
    assert token_files.round_trip(make([]), tokenizer_path()).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 4), min_size=1, max_size=8), st.integers(0, 300), st.sampled_from([8, 1 << 16]))
def test_subset_sum(rows, budget, window):
    lengths, counts = np.array(list(rows)), np.array(list(rows.values()))
    taken = mixing.subset_sum(lengths, counts, budget, window)
    assert (taken >= 0).all() and (taken <= counts).all()
    got, total = int((taken * lengths).sum()), int((lengths * counts).sum())
    assert abs(got - min(budget, total)) <= lengths.max()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 4)), min_size=1, max_size=6), st.floats(0, 400), st.sampled_from([1, 4, 1 << 16]))
def test_subset_sum_is_the_nearest(pairs, budget, window):
    lengths, counts = (np.array(x) for x in zip(*pairs))
    taken = mixing.subset_sum(lengths, counts, budget, window)
    assert (taken >= 0).all() and (taken <= counts).all() and not taken[lengths == 0].any()
    sums = {0}
    for n, c in pairs:
        sums = {s + n * k for s in sums for k in range(c + 1)}
    want = min(abs(s - budget) for s in sums)
    assert abs(int((taken * lengths).sum()) - budget) == pytest.approx(want, abs=1e-6)


def test_subset_sum_gives_back_and_takes():
    for lengths, counts, budget in (([10, 7], [10, 10], 70), ([5, 3], [4, 3], 9), ([7, 11, 500], [3, 2, 1], 29), ([10**6, 1], [1, 10**5], 6 * 10**5)):
        taken = mixing.subset_sum(np.array(lengths), np.array(counts), budget)
        got = int((taken * np.array(lengths)).sum())
        assert got == (budget if budget < 10**5 else 10**6)


def test_subset_sum_of_one_huge_and_many_lengths_is_bounded():
    lengths = np.concatenate([np.arange(1, 5000), [3 * 10**8, 10**9]])
    counts = np.concatenate([np.full(4999, 1000), [1, 1]])
    total = int((lengths * counts).sum())
    for budget in (total // 3, total - 10**9 - 17, 5 * 10**7 + 1):
        taken = mixing.subset_sum(lengths, counts, budget)
        assert int((taken * lengths).sum()) == budget


def test_mix(make, odd):
    rows = odd + [(100 + i, " ".join(["w"] * (1 + i % 37)), "en", "abcdefg"[i % 7]) for i in range(700)]
    first = sorted(map(tuple, mixing.mix(make(rows)).collect()), key=str)
    assert first == sorted(map(tuple, mixing.mix(make(rows)).collect()), key=str)
    assert len(first) == len(rows)
    source = {r[0]: r[3] for r in rows}
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(size.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            rest -= target[s]
        open_ -= over
    taken = defaultdict(int)
    for doc_id, n, source_size, goal, copies, words in first:
        s = source[doc_id]
        assert source_size == size[s] and goal == pytest.approx(target[s]) and words == copies * n and 0 <= copies <= 2
        taken[s] += words
    for s in names:
        assert abs(taken[s] - target[s]) <= 1 or s == "c"
    assert mixing.mix(make([])).collect() == []
