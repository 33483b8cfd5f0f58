import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.llm import attention, decontamination, jaccard, language, lm, quality, substrings
from vecloom.llm.components import connected_components
from vecloom.llm.queries import tokenizer_path
from vecloom.llm.suffixes import suffix_array

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    g = np.random.default_rng(seed)
    return [WORDS[i] for i in g.integers(0, len(WORDS), n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.fixture(scope="module")
def repeated(odd):
    base = " ".join(prose(1, 300))
    same = "abc " * 200
    rows = list(odd) + [(20, base), (21, "x" + base[:900] + " end"), (22, base[50:700] + base[40:800]), (23, same), (24, "y" * 900)]
    rows += [(30 + i, f"{i} " * 30 + base[200:900] + f" {i * 7}" * 40) for i in range(12)]
    return rows


@pytest.mark.parametrize("most", [256, 1])
def test_remove_repeats(make, repeated, most):
    import hashlib
    length = 400
    got = Counter(tuple(r) for r in substrings.remove_repeats(make(repeated), most=most).collect())
    texts = [(r[0], (r[1] or "").encode()) for r in repeated]
    seen = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    want = Counter()
    for doc_id, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        want[doc_id, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert got == want
    assert substrings.remove_repeats(make([])).collect() == []


def near_copies():
    rows = []
    for g in range(12):
        base = prose(g, 30 + 25 * g)
        for c in range(6):
            words = list(base)
            for k in range(c):
                words[(k * 37 + c) % len(words)] = f"new{c}{k}"
            rows.append((1000 + 10 * g + c, " ".join(words)))
    return rows


def brute_components(rows):
    sets = []
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc_id, {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return Counter((i, len(s), find(i) if i is not None else None) for i, s in sets)


@pytest.mark.parametrize("frequent", [32, 2])
def test_jaccard_components(make, odd, frequent):
    rows = list(odd) + near_copies()
    got = Counter(tuple(r) for r in jaccard.jaccard_components(make(rows), frequent=frequent).collect())
    assert got == brute_components(rows)
    assert jaccard.jaccard_components(make([])).collect() == []


def test_combinations():
    tokens = np.sort(np.random.default_rng(4).integers(0, 2**63, 30).astype(np.uint64))
    block = jaccard.mixed(tokens + jaccard.MIX[0]) % np.uint64(4)
    for k in (1, 2, 3):
        groups = sum(len(list(itertools.combinations(range(int((block == g).sum())), k))) for g in range(4))
        made = jaccard.combinations(tokens, 4, k)
        assert len(made) == len(set(made.tolist())) == groups
    assert len(jaccard.combinations(tokens[:1], 4, 2)) == 0


def test_extended_signatures_of_linked_sets_meet():
    g = np.random.default_rng(5)
    linked = 0
    for n in list(range(1, 60)) * 8 + [200, 500, 3000] * 5:
        a = np.unique(g.integers(0, 2**63, n).astype(np.uint64))
        drop, add = g.integers(0, n // 5 + 2), g.integers(0, n // 5 + 2)
        b = np.unique(np.concatenate([g.permutation(a)[drop:], g.integers(0, 2**63, add).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if len(b) and 100 * shared >= 80 * (len(a) + len(b) - shared):
            linked += 1
            assert np.intersect1d(jaccard.extended(a, 80), jaccard.extended(b, 80)).size
    assert linked > 150


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 130)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {j: 100 for j in range(100, 130)}


def test_segmentations_sum_to_brute_force():
    pieces = {"a": 2, "b": 3, "ab": 4, "ba": 5, "aba": 6}
    lattice = language.Lattice(pieces, 3)
    g = np.random.default_rng(0)
    prob = g.random((8, 2)) / 8
    prob[0] = 0

    def total(w, lang):
        if not w:
            return 1.0
        return sum(prob[pieces.get(w[:k], 1 if k == 1 else 0), lang] * total(w[k:], lang) for k in range(1, min(3, len(w)) + 1))

    words = ["a", "abab", "ab", "bacab", "abababab" * 20]
    got = lattice.log_marginals(words, prob)
    for w, row in zip(words[:4], got):
        assert np.exp(row) == pytest.approx([total(w, 0), total(w, 1)])
    assert np.isfinite(got).all()
    out = np.zeros_like(prob)
    lattice.expected(["abab"], np.array([3.0]), np.array([1]), prob, out)
    # Every segmentation covers each character once.
    assert sum(out[n, 1] * len(p) for p, n in pieces.items()) + out[1, 1] == pytest.approx(12.0) and out[:, 0].sum() == 0


@pytest.mark.parametrize("piece", [3, 4, 7, 50])
def test_long_runs_are_summed_in_pieces(piece):
    lattice = language.Lattice({"a": 2, "b": 3, "ab": 4, "ba": 5, "aba": 6}, 3)
    g = np.random.default_rng(1)
    prob = g.random((8, 3)) / 8
    prob[0] = 0
    words = ["".join(g.choice(list("abc"), n)) for n in (1, 5, 49, 50, 51, 52, 400)]
    assert lattice.log_marginals(words, prob, piece=piece) == pytest.approx(lattice.log_marginals(words, prob, piece=1000))


def test_language_of_unbroken_text(make):
    """Millions of letters without a space are learned from and told."""
    g = np.random.default_rng(2)
    run = {x: "".join(g.choice(list(a), 1_000_000)) for x, a in (("aa", "abcd"), ("zz", "wxyzé"))}
    rows = [(i, run[x] if i > 27 else run[x][:2000], x) for i, x in enumerate(["aa", "zz"] * 15)]
    got = {r.doc_id: r for r in language.language_of(make(rows), tokenizer_path("piece_bpe_32k.model"), rounds=1).collect()}
    assert all(got[r[0]].lang_pred == r[2] and got[r[0]].score > 0.99 for r in rows)


def test_learned_probabilities_equal_brute_force(make):
    """One round of counting from equal probabilities, all segmentations enumerated."""
    path = tokenizer_path("piece_bpe_32k.model")
    pieces = language.pieces_of_model(path, 8)
    rows = [(i, "The cat, the tea!", "en") for i in range(4)] + [(9, "eine Katze", "de"), (10, None, "de"), (11, "lost", None)]
    langs, prob = language.learn(make(rows), path, rounds=1)
    assert langs == ["de", "en"]
    size = len(pieces) + 2

    def cuts(w):
        if not w:
            yield ()
        for k in range(1, min(8, len(w)) + 1):
            n = pieces.get(w[:k], 1 if k == 1 else 0)
            if n:
                for rest in cuts(w[k:]):
                    yield (n, *rest)

    for lang, words in (("de", ["eine", "katze"]), ("en", ["the", "cat", "the", "tea"] * 4)):
        want = np.full(size, 0.01)
        want[0] = 0
        for w in words:
            every = list(cuts(language.START + w))
            weight = np.array([float(size) ** -len(c) for c in every])
            for c, p in zip(every, weight / weight.sum()):
                np.add.at(want, list(c), p)
        assert prob[:, langs.index(lang)] == pytest.approx(want / want.sum())


def test_language(make, odd):
    text = {"en": "the house and the garden were with them this morning", "de": "das haus und der garten waren nicht für uns heute morgen"}
    rows = list(odd) + [(100 + i, f"{text[x]} {i}", x) for i, x in enumerate(["en", "de"] * 30)]
    got = language.language_of(make(rows), tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    for i in (3, 4, 5, 9):
        assert by_id[i][0].lang_pred == "und" and by_id[i][0].score == 0
    assert all(by_id[100 + i][0].lang_pred == x for i, x in enumerate(["en", "de"] * 30))
    assert language.language_of(make([]), tokenizer_path("piece_bpe_32k.model")).collect() == []


@pytest.fixture(scope="module")
def model():
    """A small vocabulary with common ids, ids never seen, and classes of several ids; values far from their start."""
    g = np.random.default_rng(5)
    words = attention.Vocabulary(np.concatenate([1000 / np.arange(1, 200), np.zeros(700), [50]]))
    start = attention.Attention(words)
    return attention.Attention(words, {k: v + g.normal(size=v.shape).astype(np.float32) * np.float32(0.2) for k, v in start.p.items()})


def brute_log_probs(model, ranks):
    """Log probabilities of every next rank after each place of one sequence, in plain steps."""
    p, words = model.p, model.words
    inputs = np.concatenate([[0], ranks[:-1]])
    out = []
    for t in range(len(ranks)):
        first = max(0, t // attention.STEP * attention.STEP + attention.STEP - attention.SPAN)
        x = p["E"][inputs[first:t + 1]].astype(float)
        s = (x[-1] @ p["q"]) @ (x @ p["k"]).T / np.sqrt(attention.WIDTH) + p["r"][t - np.arange(first, t + 1)]
        s = np.exp(s - s.max())
        h = x[-1] + (s / s.sum()) @ (x @ p["v"]) @ p["o"]
        z = h @ p["w"].T + p["b"]
        z -= np.log(np.exp(z - z.max()).sum()) + z.max()
        inside = h @ p["M"].T + p["m"]
        every = np.empty(len(words))
        for c in range(len(z)):
            a, b = words.starts[c], words.starts[c + 1]
            every[a:b] = z[c] + inside[a:b] - np.log(np.exp(inside[a:b]).sum())
        out.append(every)
    return np.array(out)


def test_vocabulary():
    words = attention.Vocabulary(np.concatenate([1000 / np.arange(1, 200), np.zeros(2000), [50]]))
    assert sorted(words.rank.tolist()) == list(range(len(words))) and words.rank[-1] == 0
    sizes = np.diff(words.starts)
    assert sizes[0] == 1 and sizes.min() > 0 and sizes.max() <= attention.LARGEST and sizes.sum() == len(words)
    assert (np.repeat(np.arange(len(sizes)), sizes) == words.classes).all()
    total = np.exp(words.class_bias[words.classes] + words.bias)
    assert total.sum() == pytest.approx(1, abs=1e-5)


def test_scores_equal_brute_force_and_next_ids_sum_to_one(model):
    g = np.random.default_rng(1)
    lengths = np.array([1, 40, 16, 3, 90])
    ranks = np.minimum(g.integers(0, 900, lengths.sum()), g.integers(0, 901, lengths.sum()))
    got = np.zeros(len(ranks))
    for ids, ok, goal, scored, place in attention.batches_of(ranks, lengths, 3):
        got[place[scored]] = model.log_probs(ids, ok, goal, scored)
    at = 0
    for n in lengths:
        every = brute_log_probs(model, ranks[at:at + n])
        assert np.exp(every).sum(1) == pytest.approx(1, abs=1e-5)
        assert got[at:at + n] == pytest.approx(every[np.arange(n), ranks[at:at + n]], abs=1e-3)
        at += n


def test_gradient(model):
    g = np.random.default_rng(1)
    ids, goal = g.integers(0, 900, (3, attention.SPAN)), g.integers(0, 900, (3, attention.STEP))
    valid = np.ones((3, attention.SPAN), bool)
    valid[0, :attention.SPAN - attention.STEP] = False
    scored = valid[:, attention.SPAN - attention.STEP:].copy()
    scored[1, 3:7] = False
    whole, rows = model.gradient(ids, valid, goal, scored)
    full = {name: np.zeros(v.shape) for name, v in model.p.items()}
    for name, at, v in [(name, slice(None), v) for name, v in whole.items()] + rows:
        full[name][at] += v

    def loss(name, place, by):
        values = {k: v.astype(float) for k, v in model.p.items()}
        values[name][place] += by
        return -attention.Attention(model.words, values).log_probs(ids, valid, goal, scored).mean()

    for name, v in full.items():
        most = np.unravel_index(np.argsort(-np.abs(v).ravel())[[0, 3, 9]], v.shape)
        for place in zip(*most):
            assert (loss(name, place, 1e-3) - loss(name, place, -1e-3)) / 2e-3 == pytest.approx(v[place], rel=0.02, abs=1e-5)


def test_windows_score_each_position_once():
    lengths = np.array([1, 40, 16, 3])
    hits = np.zeros(60, int)
    for _, _, _, scored, place in attention.batches_of(np.arange(60), lengths, 2):
        np.add.at(hits, place[scored], 1)
    assert (hits == 1).all()


def test_stretches_cover_every_word_once():
    texts = [None, b"", b"one", " ".join(prose(3, 64)).encode(), " ".join(prose(4, 5000)).encode()]
    for text in texts:
        every = [x for turn in range(16) for x in lm.stretches(text, 16, turn)]
        assert Counter(w for x, _, _ in every for w in x) == Counter((text or b"").split())
        assert sum(first for _, first, _ in every) == sum(last for _, _, last in every) == 1


def test_summed(spark):
    rows = [(k, np.full(3, i, np.float32).tobytes()) for i in range(40) for k in (-1, 4, 9)]
    got = lm.summed(spark.createDataFrame(rows, "key int, data binary").repartition(7))
    assert {k: v.tolist() for k, v in got.items()} == {k: [780.0] * 3 for k in (-1, 4, 9)}


def test_training_lifts_held_out_texts(make):
    """Words put together from syllables, in two languages, against the start: subwords by their counts, without context."""
    g = np.random.default_rng(7)
    parts = ("ba lo mi ren to sa fel gu da pri no ve cas ti".split(), "schu ker ung eit wo zim hef kro lau tze bur nig dach mel".split())
    rows = [(i, " ".join("".join(g.choice(parts[i % 2], g.integers(2, 6))) for _ in range(150)).title()) for i in range(1500)]
    held = [[r for r in lm.score_texts(make(rows), tokenizer_path(), rate=3, windows=8, rounds=n).collect() if r.held_out] for n in (0, 3)]
    start, trained = ({r.doc_id: r.score / r.n_tokens for r in x} for x in held)
    assert len(start) > 150 and set(start) == set(trained)
    gain = np.array([trained[i] - start[i] for i in start])
    assert (gain > 0).all() and gain.mean() > 1


def test_score_texts(make, odd):
    rows = list(odd) + [(100 + i, " ".join(prose(i % 9, 120))) for i in range(60)]
    got = lm.score_texts(make(rows), tokenizer_path()).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter()
    for r in rows:
        if not held(r[0]):
            count.update((r[1] or "").encode().lower().split() + [None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in rows:
        w = (r[1] or "").encode().lower().split() + [None]
        want[r[0], held(r[0]), len(w), sum(count[x] > 0 for x in w), n, round(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)] += 1
    assert Counter((*r[:5], round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score_texts(make([]), tokenizer_path()).collect() == []


def test_importance_sample(spark, make, odd):
    rows = list(odd) + [(100 + i, " ".join(["good", "fine"] * 20 if i % 2 else ["junk", "spam"] * 20)) for i in range(200)]
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(100)] + [(None, 1), (5000, 1), (101, None)], "doc_id long, quality int")
    got = quality.importance_sample(make(rows), labels).collect()
    again = quality.importance_sample(make(rows), labels).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    assert sum(r.kept for r in got) == round(51 / 101 * len(rows))
    good = [r for r in got if r.doc_id is not None and r.doc_id >= 100]
    assert np.mean([r.kept == bool(r.doc_id % 2) for r in good]) > 0.9
    assert quality.importance_sample(make([]), labels).collect() == []


def test_contaminated(spark, make, odd):
    items = [(i, " ".join(prose(1000 + i, 30))) for i in range(8)] + [(50, None), (51, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = list(odd) + [(100 + i, " ".join(prose(i, 200))) for i in range(60)]
    leaked = items[3][1].split()
    leaked[7], leaked[15] = "other", "words"
    rows += [(500, " ".join(prose(70, 90)) + " " + items[2][1].upper() + ". " + " ".join(prose(71, 60))),
             (501, " ".join(prose(72, 50) + leaked + prose(73, 50)))]
    got = decontamination.contaminated(make(rows), bench, common=1.0).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(500, 2), (501, 3)}
    best = {r.doc_id: r for r in got}
    assert best[500].lcs == 1.0 and best[501].lcs == pytest.approx(28 / 30)
    assert decontamination.contaminated(make([]), bench).collect() == []
    assert decontamination.contaminated(make(rows), bench.limit(0)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=9), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=12))
def test_common_subsequence(x, y):
    table = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
    assert decontamination.common_subsequence(x, y).bit_count() == table[-1, -1]


def test_decontamination_parts():
    rng = np.random.default_rng(4)
    lengths = rng.integers(0, 90, 60)
    marks = rng.integers(0, 41, lengths.sum()).astype("<u2")
    row, place, word = decontamination.features_of(marks, lengths, np.arange(-1, 40))
    assert len(row) == (marks > 0).sum() and all(marks[(np.cumsum(lengths) - lengths)[r] + p] == w + 1 for r, p, w in zip(row, place, word))
    items = [rng.integers(0, 40, n) for n in (3, 20, 40)]
    counts = np.array([np.bincount(x, minlength=40) for x in items]).T.astype(np.uint8)
    may = decontamination.coverable(row, word, 60, counts, np.array([3, 20, 40]), 0.7)
    for r in range(60):
        own = set(word[row == r].tolist())
        for i, x in enumerate(items):
            assert may[r, i] == (sum(w in own for w in x.tolist()) / len(x) >= 0.7)
    key, feat, n = decontamination.passages_of(row, place, word, 16, 32)
    starts, value = decontamination.weighted(key, feat, n, rng.random(40) + 0.1)
    dense = np.zeros((len(starts), 40))
    dense[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key)))), feat] = value
    random = rng.normal(size=(40, 8)).astype(np.float32)
    for most in (1, 300, 1 << 21):  # what is kept goes into the result early, now and then or at the end
        gram = decontamination.Gram(random, most)
        for _ in range(2):
            gram.add(starts, feat, value)
        assert np.allclose(gram.result(), 2 * dense.T @ (dense @ random), rtol=1e-4, atol=1e-4)


def test_odd_cells_never_say_more_than_two_sets_differ():
    g = np.random.default_rng(6)
    for n, k in [(0, 3), (1, 1), (40, 7), (400, 90), (5000, 3000)]:
        a = np.unique(g.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[k:], g.integers(0, 2**63, k).astype(np.uint64)]))
        told = int(np.bitwise_count(jaccard.odd_cells(a) ^ jaccard.odd_cells(b)).sum())
        assert told <= len(np.setxor1d(a, b))
        assert n > 400 or told >= 0.9 * len(np.setxor1d(a, b))


def test_copies_that_differ_too_much_are_told_apart_before_they_are_paired(make, monkeypatch):
    """A large group of copies of which none links: pairs would grow with the square of the group."""
    g = np.random.default_rng(7)
    text = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = list(text)
        for at in g.choice(300, 6, replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    tested, kept = [], jaccard.kept_by_prefix
    monkeypatch.setattr(jaccard, "kept_by_prefix", lambda pairs, *rest: (tested.append(pairs.count()), kept(pairs, *rest))[1])
    got = Counter(tuple(r) for r in jaccard.jaccard_components(make(rows)).collect())
    assert got == brute_components(rows)
    assert tested[-1] <= 60
