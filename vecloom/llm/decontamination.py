"""Benchmark decontamination: latent semantic candidates, then longest common subsequences and an answer check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import ragged, slices, texts_of
from vecloom.plans.numbering import number_rows
from vecloom.plans.scratch import discard, stored

#: ASCII upper to lower case; ASCII that is neither letter nor digit to a space.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def common_subsequence(item: list, words: list) -> int:
    """Bits of the positions of ``item`` in one longest common subsequence (bit i: word i is matched)."""
    where: dict = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    free, rows = full, [full]
    for w in words:
        hit = where.get(w, 0)
        both = free & hit
        free = ((free + both) | (free & ~hit)) & full
        rows.append(free)
    # Walk back: a zero bit that first appears in a row ends a match there.
    matched, i, j = 0, len(item), len(words)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            matched |= 1 << (i - 1)
            i, j = i - 1, j - 1
    return matched


def tree_sum(parts: DataFrame, shape: tuple[int, ...], kind: type = np.float64) -> np.ndarray:
    """Sum of the arrays of ``kind`` in ``parts(data)``, one row per input task, in two steps of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_buffer(), kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], ["data"])

    n = max(1, int(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    some = parts.repartition(n).mapInArrow(add, "data binary")
    rows = some.repartition(1).mapInArrow(add, "data binary").collect()
    return sum((np.frombuffer(r.data, kind).reshape(shape) for r in rows), np.zeros(shape))


def marked(rows: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Stored ``(doc_id, marks)`` of ``rows(doc_id, text)``: 1 + the number of each word of a text, 0 for words without one."""
    sent, kind = rows.sparkSession.sparkContext.broadcast(number), marks_kind(len(number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {w: n + 1 for w, n in sent.value.items()}.get
        for batch in slices(batches):
            lists = [plain_words(t) for t in texts_of(batch)]
            ends = np.cumsum([0] + [len(x) for x in lists])
            marks = np.fromiter(map(get, chain.from_iterable(lists), repeat(0)), kind, int(ends[-1]))
            data = [marks[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "marks"])

    return stored(rows.select("doc_id", "text").mapInArrow(run, "doc_id bigint, marks binary"), "marks")


def marks_kind(n: int) -> str:
    return "<u2" if n < 65_535 else "<u4"


def marks_of(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The marks of all rows of a batch in a row, and the words of each row."""
    data = batch.column(batch.schema.get_field_index("marks")).to_pylist()
    return np.frombuffer(b"".join(data), kind), np.array([len(x) for x in data], np.int64) // np.dtype(kind).itemsize


def features_of(marks: np.ndarray, lengths: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word position and feature of every feature word; ``feature`` gives that of a mark, -1 for none."""
    found = feature[marks]
    at = np.flatnonzero(found >= 0)
    row = np.repeat(np.arange(len(lengths)), lengths)[at]
    return row, at - (np.cumsum(lengths) - lengths)[row], found[at]


def coverable(row: np.ndarray, word: np.ndarray, n: int, held: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """``(row, item)`` flags: at least the share ``least`` of the item's words stand in the row at all, in any order.

    No common subsequence of a pair without it reaches the share. ``held (word, item)`` counts an item's words.
    """
    out = np.zeros((n, len(sizes)), bool)
    key = np.unique(row * len(held) + word)
    row, word = key // len(held), key % len(held)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(row))
    for a in range(0, len(starts), 256):
        part = slice(starts[a], ends[min(a + 256, len(starts)) - 1])
        have = np.add.reduceat(held[word[part]], starts[a:a + 256] - starts[a], axis=0, dtype=np.int32)
        out[row[starts[a:a + 256]]] = have / sizes >= least
    return out


class Gram:
    """A'A times a matrix for sparse rows that come in batches: products of values by pair of features, then their rows.

    Pairs are kept up to ``most`` at a time and then go into the result, so memory does not grow with the rows.
    """

    def __init__(self, random: np.ndarray, most: int = 1 << 21):
        self.random, self.most, self.z = random, most, np.zeros(random.shape)
        self.keys, self.sums, self.n = [], [], 0

    def add(self, starts: np.ndarray, feat: np.ndarray, value: np.ndarray) -> None:
        size = np.diff(np.append(starts, len(feat)))
        for a, b in cut_by(size * size, 1 << 21):
            lo, hi = starts[a], starts[b] if b < len(starts) else len(feat)
            each = np.repeat(size[a:b], size[a:b])
            other = ragged(np.repeat(starts[a:b], size[a:b]), each)
            key = np.repeat(feat[lo:hi].astype(np.int64), each) * len(self.random) + feat[other]
            key, at = np.unique(key, return_inverse=True)
            self.keys.append(key)
            self.sums.append(np.bincount(at, np.repeat(value[lo:hi], each).astype(float) * value[other], len(key)))
            self.n += len(key)
            if self.n > self.most:
                self._merge()
                if self.n > self.most // 2:
                    self._flush()

    def _merge(self) -> None:
        key, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.keys, self.sums, self.n = [key], [np.bincount(at, np.concatenate(self.sums), len(key))], len(key)

    def _flush(self) -> None:
        v = len(self.random)
        key, w = self.keys[0], self.sums[0]
        for a in range(0, len(key), 1 << 14):
            f, g = key[a:a + (1 << 14)] // v, key[a:a + (1 << 14)] % v
            heads = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            self.z[f[heads]] += np.add.reduceat(w[a:a + (1 << 14), None] * self.random[g], heads, axis=0)
        self.keys, self.sums, self.n = [], [], 0

    def result(self) -> np.ndarray:
        if self.keys:
            self._merge()
            self._flush()
        return self.z


def cut_by(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive places of about ``most`` weight, at least one place each."""
    part = np.cumsum(weights) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    ends = np.concatenate([[0], cuts, [len(weights)]]).tolist()
    return ((a, b) for a, b in zip(ends[:-1], ends[1:]) if b > a)


def passages_of(row, place, feature, step: int, size: int):
    """Incidence ``(passage key, feature)`` of the feature words, one entry per passage and word.

    Passages start every ``step`` words and hold ``size``; a passage's key is ``row << 32 | start / step``.
    """
    keys, feats = [], []
    for back in range(-(-size // step)):
        start = place // step - back
        ok = (start >= 0) & (place < start * step + size)
        keys.append((row[ok].astype(np.int64) << 32) | start[ok])
        feats.append(feature[ok])
    key, feat = np.concatenate(keys), np.concatenate(feats)
    order = np.lexsort((feat, key))
    key, feat = key[order], feat[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (feat[1:] != feat[:-1])
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(key)]]))
    return key[new], feat[new], count


def weighted(key: np.ndarray, feat: np.ndarray, count: np.ndarray, idf: np.ndarray):
    """Starts of the passages in the incidence, and its tf-idf values scaled to unit rows."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    value = (1.0 + np.log(count)) * idf[feat]
    if len(key):
        norm = np.sqrt(np.add.reduceat(value * value, starts))
        value = value / np.repeat(np.maximum(norm, 1e-12), np.diff(np.concatenate([starts, [len(key)]])))
    return starts, value.astype(np.float32)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", rank: int = 256, size: int = 32, step: int = 16,
    common: float = 0.003, least: int = 6, cosine: float = 0.4, lcs: float = 0.8, answer: float = 0.6, paraphrase: float = 0.7,
    block: int = 256, seed: int = 2,
) -> DataFrame:
    """``(doc_id, item_id, cosine, lcs, answer, position)``: each document that holds a benchmark item, and the item.

    The items are taken in blocks of ``block`` rows by id; each block is one job over all rows, so what is broadcast is
    bounded by the block. Per block the texts are split once, into stored marks of the items' words. Features are the items' words, without those in over ``common`` of all passages
    (``size`` words, one every ``step``) except an item's ``least`` rarest. A randomised SVD (one power step: A'A times a
    random matrix, summed over all passages in tasks) gives ``rank`` directions; passages and items are compared by cosine
    in that space, in rows that hold enough of an item's words to reach the least share. A passage with ``cosine`` or more is aligned with the item: ``lcs`` is the share of the item's words in a longest
    common subsequence with the passage and its surroundings, ``answer`` the same for the item's last fifth (3 words at
    least). It is a hit if lcs >= ``lcs``, or lcs >= ``paraphrase`` with answer >= ``answer``.

    Words are runs of letters and digits, A-Z lower-cased. Null or wordless texts and items never hit; a null id shows as
    null; repeated rows hit each; items of one id are one item per row. Of several hits of a row and item the best by (lcs, cosine, first place) is shown.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = number_rows(benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")), ["item_id", "text"], "_n")
    total = items.count()
    schema = "doc_id bigint, item_id bigint, cosine double, lcs double, answer double, position bigint"
    out = None
    for first in range(0, total, block):
        part = items.where((F.col("_n") >= first) & (F.col("_n") < first + block)).select("item_id", "text").collect()
        held = [(r.item_id, plain_words(r.text.encode() if r.text else None)) for r in part]
        held = [(i, w) for i, w in held if w]
        if not held:
            continue
        words = sorted({w for _, ws in held for w in ws})
        word = {w: i for i, w in enumerate(words)}
        kind = marks_kind(len(words))
        marks = marked(rows, word)

        def count(batches: Iterator[pa.RecordBatch], v=len(words), kind=kind) -> Iterator[pa.RecordBatch]:
            df, every = np.zeros(v + 1), np.arange(-1, v)
            for batch in slices(batches):
                found, lengths = marks_of(batch, kind)
                row, place, feature = features_of(found, lengths, every)
                seen = np.unique(((row.astype(np.int64) << 24 | place // size) << 24) | feature) & (1 << 24) - 1
                df[:v] += np.bincount(seen, minlength=v)
                df[v] += (-(-lengths // size)).sum()
            yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary())], ["data"])

        df = tree_sum(marks.select("marks").mapInArrow(count, "data binary"), (len(words) + 1,))
        passages, df = df[-1], df[:-1]
        rare = df <= max(1.0, common * passages)
        for _, ws in held:
            own = sorted({word[w] for w in ws}, key=lambda f: (df[f], f))
            rare[own[:least]] = True
        chosen = np.flatnonzero(rare)
        number = {words[f]: n for n, f in enumerate(chosen.tolist())}
        feature = np.full(len(words) + 1, -1)
        feature[chosen + 1] = np.arange(len(chosen))
        idf = np.log((passages + 1.0) / (df[chosen] + 1.0)) + 1e-3
        v, width = len(chosen), min(len(chosen), rank + 8)
        random = np.random.default_rng(seed).normal(size=(v, width)).astype(np.float32)
        sent = spark.sparkContext.broadcast((feature, idf, random))

        def power(batches: Iterator[pa.RecordBatch], sent=sent, kind=kind) -> Iterator[pa.RecordBatch]:
            feature, idf, random = sent.value
            gram = Gram(random)
            for batch in slices(batches):
                key, feat, n = passages_of(*features_of(*marks_of(batch, kind), feature), step, size)
                if len(key):
                    starts, value = weighted(key, feat, n, idf)
                    gram.add(starts, feat, value)
            yield pa.RecordBatch.from_arrays([pa.array([gram.result().astype(np.float32).tobytes()], pa.binary())], ["data"])

        z = tree_sum(marks.select("marks").mapInArrow(power, "data binary"), (v, width), np.float32)
        # The items are rows of the matrix as well, as heavy together as all passages, so that rare ones have their direction too.
        f = [(np.array([number[w] for w in ws if w in number], np.int64)) for _, ws in held]
        key = np.repeat(np.arange(len(f)), [len(x) for x in f])
        ik, iv, ic = passages_of(key, np.zeros(len(key), np.int64), np.concatenate(f), 1, 1)
        starts, value = weighted(ik, iv, ic, idf)
        dense = np.zeros((len(held), v))
        dense[ik >> 32, iv] = value
        z += max(1.0, passages / len(held)) * (dense.T @ (dense @ random))
        # Eigenvectors of A'A from its action on the random matrix alone (single pass).
        q, _ = np.linalg.qr(z)
        small = np.linalg.lstsq((random.T @ q), z.T @ q, rcond=None)[0]
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        basis = q @ vectors[:, np.argsort(-values)[:rank]]
        latent = dense @ basis
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        basis, latent = basis.astype(np.float32), latent.astype(np.float32)
        # Items as word numbers: a word that is in no item matches nothing.
        items_held = [(i, [word[w] + 1 for w in ws]) for i, ws in held]
        counts = np.zeros((len(words), len(held)), np.uint8 if max(len(ws) for _, ws in held) < 256 else np.int32)
        for n, (_, ws) in enumerate(items_held):
            np.add.at(counts, (np.array(ws) - 1, n), 1)
        sent = spark.sparkContext.broadcast((feature, idf, basis, latent, items_held, counts))

        def search(batches: Iterator[pa.RecordBatch], sent=sent, kind=kind) -> Iterator[pa.RecordBatch]:
            feature, idf, basis, latent, held, counts = sent.value
            sizes, every = np.array([len(x) for _, x in held]), np.arange(-1, len(counts))
            for whole in slices(batches):
                marks, lengths = marks_of(whole, kind)
                row, _, found = features_of(marks, lengths, every)
                may = coverable(row, found, len(lengths), counts, sizes, min(lcs, paraphrase))
                batch = whole.take(pa.array(np.flatnonzero(may.any(axis=1))))
                if not batch.num_rows:
                    continue
                may = may[may.any(axis=1)]
                marks, lengths = marks_of(batch, kind)
                first = np.cumsum(lengths) - lengths
                key, feat, n = passages_of(*features_of(marks, lengths, feature), step, size)
                if not len(key):
                    continue
                starts, value = weighted(key, feat, n, idf)
                y = np.add.reduceat(value[:, None] * basis[feat], starts, axis=0)
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                best: dict[tuple[int, int], tuple] = {}
                ids = batch.column(0)
                for a in range(0, len(y), 8192):
                    near = y[a:a + 8192] @ latent.T
                    for p, i in zip(*np.nonzero((near >= cosine) & may[key[starts[a:a + 8192]] >> 32])):
                        k = int(key[starts[a + p]])
                        r, at = k >> 32, (k & 0xFFFFFFFF) * step
                        item_id, item = held[i]
                        slack = max(size, len(item))
                        low, high = max(0, at - slack), at + size + slack
                        bits = common_subsequence(item, marks[first[r] + low:first[r] + min(high, lengths[r])].tolist())
                        share = bits.bit_count() / len(item)
                        if share < min(lcs, paraphrase):
                            continue
                        last = min(len(item), max(3, len(item) // 5))
                        told = (bits >> len(item) - last).bit_count() / last
                        if share >= lcs or (share >= paraphrase and told >= answer):
                            hit = (share, float(near[p, i]), -at, told)
                            if best.get((r, i), (-1.0,)) < hit:
                                best[r, i] = hit
                if best:
                    at = list(best)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[r].as_py() for r, _ in at], pa.int64()), pa.array([held[i][0] for _, i in at], pa.int64()),
                         pa.array([min(1.0, best[x][1]) for x in at]), pa.array([best[x][0] for x in at]), pa.array([best[x][3] for x in at]),
                         pa.array([-best[x][2] for x in at], pa.int64())],
                        ["doc_id", "item_id", "cosine", "lcs", "answer", "position"])

        hits = stored(marks.mapInArrow(search, schema), "hits")
        discard(marks)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else spark.createDataFrame([], schema)
