"""Suffix-array dedup: removes bytes of strings of a given length that start at two places or more."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import lookup, slices
from vecloom.llm.suffixes import suffix_array
from vecloom.plans.scratch import stored

GRAM, BLOCK = 32, 64
FACTOR = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of all ``GRAM``-byte strings of ``data`` (uint8)."""
    h, factor, n = data.astype(np.uint64) + np.uint64(1), FACTOR, 1
    while n < GRAM:
        h = h[:-n] * np.uint64(factor) + h[n:]
        factor, n = factor * factor & (1 << 64) - 1, 2 * n
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(position, first, last, hash)``: each window start from first to last has its anchor at position.

    The anchor of a ``length``-byte string is its least ``GRAM``-byte string by hash, the last one of equals: it
    depends on the string alone, so equal strings have it at the same distance.
    """
    h = gram_hashes(data)
    span = length - GRAM + 1
    count = len(h) - span + 1  # window starts
    low, n = h, 1
    while 2 * n <= span:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    low = np.minimum(low[:count], low[span - n:span - n + count])
    fresh = np.flatnonzero(h[span - 1:] == low).tolist()  # the string that enters is the new least
    fresh.append(count)
    found, firsts, s, f = [], [], 0, 0
    while s < count:
        while fresh[f] < s:
            f += 1
        at = s + span - 1 if fresh[f] == s else s + int(np.flatnonzero(h[s:s + span] == low[s])[-1])
        if fresh[f] == s:
            f += 1
        found.append(at)
        firsts.append(s)
        s = min(at + 1, fresh[f])
    found, firsts = np.array(found), np.array(firsts)
    return found, firsts, np.concatenate([firsts[1:] - 1, [count - 1]]), h[found]


def repeated_starts(regions: list[tuple[bytes, bytes, int]]) -> list[int]:
    """Which window starts of each region of one core occur twice: bit t for the start t bytes after the block's base.

    A region is (bytes before the core, bytes after it, copies); windows take ``BLOCK`` - 1 - t bytes before the core and t
    after it. The core, equal in all, is one symbol, so a window is ``BLOCK`` symbols. In the suffix array of all
    regions equal windows are neighbours.
    """
    owned = [((1 << len(right) + 1) - 1) & ~((1 << BLOCK - 1 - len(left)) - 1) for left, right, _ in regions]
    if len(regions) == 1:
        return [owned[0] if regions[0][2] > 1 else 0]
    text: list[int] = []
    base = []
    for i, (left, right, _) in enumerate(regions):
        base.append(len(text) - (BLOCK - 1 - len(left)))
        text += left
        text.append(256)
        text += right
        text.append(257 + i)  # a different end for each region
    joined = "".join(map(chr, (c if c < 0xD800 else c + 0x800 for c in text)))
    owner = [0] * len(text)
    for i, (left, right, _) in enumerate(regions):
        at = base[i] + BLOCK - 1 - len(left)
        for k in range(at, base[i] + len(right) + 1):
            owner[k] = i + 1
    out = [own if r[2] > 1 else 0 for own, r in zip(owned, regions)]
    last, window = -1, ""
    for s in suffix_array(text):
        if not owner[s]:
            continue
        here = joined[s:s + BLOCK]
        if last >= 0 and here == window:
            for x in (last, s):
                i = owner[x] - 1
                out[i] |= 1 << x - base[i]
        last, window = s, here
    return out


def parts_of(data: bytes, length: int, wanted) -> list[tuple[bytes, bytes, bytes, int]]:
    """``(core digest, before, after, base)`` of the blocks of all wanted anchors.

    A block holds the windows whose anchor is 64 b to 64 b + 63 bytes after their start; its core is what they all contain.
    """
    import xxhash
    array = np.frombuffer(data, np.uint8)
    at, first, last, h = anchors(array, length)
    out = []
    digest = xxhash.xxh3_128_digest
    core_size = length - BLOCK + 1
    for k in np.flatnonzero(wanted(h)).tolist():
        a, lo, hi = int(at[k]), int(first[k]), int(last[k])
        for b in range((a - hi) // BLOCK, (a - lo) // BLOCK + 1):
            base = a - BLOCK * b - BLOCK + 1
            t0, t1 = max(0, lo - base), min(BLOCK - 1, hi - base)
            core = base + BLOCK - 1
            out.append((digest(data[core:core + core_size], seed=b), data[base + t0:core], data[core + core_size:core + core_size + t1], base))
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, bits: int = 27, most: int = 256,
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per input row.

    Texts are UTF-8 bytes, null is empty. Removed is each byte covered by a ``length``-byte string that also starts
    anywhere else, in the same text or another; matches never cross texts, overlaps count, strings are judged
    on the input. A null id is a row like any other; rows repeated with one id are texts of their own and so repeat each other; no rows give no rows.

    Strings with one anchor (see ``anchors``) and one core meet in one group as a few bytes around it, equal regions
    counted beforehand, and a suffix array finds the windows that occur twice. Anchors seen once never leave their task: a bit map of fixed
    size (2^bits bits) names the others, and what it lets through in excess finds no partner. A core shared by over ``most`` different regions is
    resolved without meeting in one task: its windows are counted by content.
    """
    if length < 2 * BLOCK + GRAM:
        raise ValueError(f"length must be {2 * BLOCK + GRAM} at least")
    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), binary.alias("data"))
    keyed = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"), F.xxhash64("data").alias("k2"), "doc_id", "data")
    longer = keyed.where(F.octet_length("data") >= length)

    def anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16 << 20):
            h, n = np.unique(np.concatenate([anchors(np.frombuffer(t, np.uint8), length)[3] for t in batch.column(0).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    cell = F.pmod("h", F.lit(1 << bits))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))
    twice = longer.select("data").mapInArrow(anchor_counts, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    bitmap = _bitmap(twice.select(((cell - cell % 64) / 64).cast("int").alias("w"), word.alias("m")), bits)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value

        def wanted(h):
            c = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
            return bitmap[c >> 6] >> (c & 63) & 1

        for batch in slices(batches, 8 << 20):
            k1, k2, cores, lefts, rights, bases = [], [], [], [], [], []
            for a, b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for core, left, right, base in parts_of(data, length, wanted):
                    k1.append(a)
                    k2.append(b)
                    cores.append(core)
                    lefts.append(left)
                    rights.append(right)
                    bases.append(base)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(cores, pa.binary()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()),
                 pa.array(bases, pa.int64())], ["k1", "k2", "core", "before", "after", "base"])

    parts = stored(longer.select("k1", "k2", "data").mapInArrow(
        cut, "k1 bigint, k2 bigint, core binary, before binary, after binary, base bigint"), "parts")
    sent.destroy()
    region = F.xxhash64("core", "before", "after").alias("region")
    distinct = parts.groupBy("core", "before", "after").agg(F.count(F.lit(1)).alias("n"))
    per_core = stored(parts.groupBy("core").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "cores")
    regions = stored(distinct.join(per_core, "core", "left_semi").withColumn("region", region), "regions")
    kinds = regions.groupBy("core").agg(F.count(F.lit(1)).alias("_k"))
    large = stored(kinds.where(F.col("_k") > most), "large")
    # At most one core per ``most`` regions is large; they are told apart by content, window by window.
    few = regions.join(large.select("core"), "core", "left_anti")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        core = None

        def close():
            if held:  # regions of one core
                masks = repeated_starts([(r[1], r[2], r[3]) for r in held])
                for r, m in zip(held, masks):
                    if m:
                        yield r[0], r[1], r[2], m - (1 << 64) if m >> 63 else m

        found: list[tuple] = []
        for batch in batches:
            for r in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if r[0] != core:
                    found.extend(close())
                    held, core = [], r[0]
                held.append(r)
            if found:
                yield _mask_rows(found)
                found = []
        found.extend(close())
        if found:
            yield _mask_rows(found)

    schema = "core binary, before binary, after binary, mask bigint"
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masks = few.select("core", "before", "after", "n").repartition(n, "core").sortWithinPartitions("core", "before", "after").mapInArrow(resolve, schema)
    # Windows of large cores: start t takes the bytes from t before the core and t after it.
    starts = F.sequence(F.lit(BLOCK - 1) - F.length("before"), F.length("after"))
    many = regions.join(large.select("core"), "core", "left_semi").select("core", "before", "after", "n", F.explode(starts).alias("t"))
    many = many.withColumn("window", F.xxhash64(
        "t", F.expr("substring(before, t - 63 + length(before) + 1, 63 - t)"), F.expr("substring(after, 1, t)"))).withColumn(
        "check", F.md5(F.concat(F.expr("substring(before, t - 63 + length(before) + 1, 63 - t)"), F.expr("substring(after, 1, t)"))))
    many = stored(many, "windows")
    again = stored(many.groupBy("core", "t", "window", "check").agg(F.sum("n").alias("_w")).where("_w > 1").withColumn(
        "key", F.md5(F.concat_ws("|", F.hex("core"), "t", "window", "check"))).select("key", "_w"), "again")
    marked = many.withColumn("key", F.md5(F.concat_ws("|", F.hex("core"), "t", "window", "check")))
    marked = lookup(marked, again, "key", "_w").where("_w IS NOT NULL")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t").cast("int"))
    masks = stored(masks.unionByName(marked.groupBy("core", "before", "after").agg(F.bit_or(bit).alias("mask"))), "masks")

    # Regions with many copies are many rows under one key on the side of the parts.
    weights = regions.select("core", "before", "after", "n", "region").join(masks, ["core", "before", "after"])
    placed = stored(lookup(
        stored(parts.select("k1", "k2", "base", F.struct("core", region).alias("key")), "placed"),
        stored(weights.select(F.struct("core", "region").alias("key"), "mask", "n"), "weights"), "key", "n").where("mask IS NOT NULL").select(
            "k1", "k2", "base", "mask"), "found")
    touched = F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << bits))
    touched_word = F.call_function("shiftleft", F.lit(1).cast("long"), (touched % 64).cast("int"))
    changed = docs.sparkSession.sparkContext.broadcast(
        _bitmap(placed.select("k1", "k2").distinct().select(((touched - touched % 64) / 64).cast("int").alias("w"), touched_word.alias("m")), bits))
    result = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def chosen(batch: pa.RecordBatch, column: int) -> np.ndarray:
        c = batch.column(column).to_numpy()
        return (changed.value[c >> 6] >> (c & 63) & 1).astype(bool)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            part = batch.filter(pa.array(~chosen(batch, 2)))
            if part.num_rows:
                yield _results(part.column(0), part.column(1).to_pylist(), [None] * part.num_rows)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            part = batch.filter(pa.array(chosen(batch, 4)))
            yield part.select(["k1", "k2", "doc_id", "data"])

    def erase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[(x["base"], x["mask"]) for x in s] if s else None for s in batch.column(2).to_pylist()]
            yield _results(batch.column(0), batch.column(1).to_pylist(), spans, length)

    clean = keyed.select("doc_id", "data", touched.alias("c")).mapInArrow(untouched, result)
    texts = keyed.withColumn("c", touched).mapInArrow(pick, "k1 bigint, k2 bigint, doc_id bigint, data binary")
    spans = placed.groupBy("k1", "k2").agg(F.collect_set(F.struct("base", "mask")).alias("spans"))
    return clean.unionByName(texts.join(spans, ["k1", "k2"], "left").select("doc_id", "data", "spans").mapInArrow(erase, result))


def _bitmap(words: DataFrame, bits: int) -> np.ndarray:
    """Bit map of fixed size from ``(w, m)``: masks of 64 bits by word."""
    found = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[found.column("w").to_numpy()] = found.column("m").to_numpy()
    return out


def _mask_rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["core", "before", "after", "mask"])


def _results(doc_ids, texts: list[bytes], spans: list, length: int = 0) -> pa.RecordBatch:
    """What is left of each text without the windows that start at base + t for each bit t of a mask."""
    sizes, removed, runs, digests = [], [], [], []
    for data, found in zip(texts, spans):
        sizes.append(len(data))
        if not found:
            removed.append(0)
            runs.append(0)
            digests.append(hashlib.sha256(data).hexdigest())
            continue
        edge = np.zeros(len(data) + 1, np.int64)
        for base, mask in found:
            t = base + np.flatnonzero(np.unpackbits(np.array([mask], "<i8").view(np.uint8), bitorder="little"))
            np.add.at(edge, t, 1)
            np.add.at(edge, t + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed.append(int(gone.sum()))
        runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        digests.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
