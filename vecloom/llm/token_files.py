"""Token ids in binary files whose document boundaries are Elias-Fano coded."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.common import process_cache, ragged, slices
from vecloom.plans.scratch import new_path

MAGIC = b"EFTOK001"
#: magic, documents, ids, bytes per id, low bits, bytes of the low and of the high part, select samples
HEADER = "<8sIIBBIII"
SAMPLE = 256


class Boundaries:
    """Non-decreasing offsets ``0 = o[0] <= ... <= o[n]`` in about 2 + log2(o[n] / n) bits each.

    The low bits stand packed in a row; the rest is a bit vector in which offset i sets bit
    ``(o[i] >> low) + i``. ``samples`` holds the byte of every 256th set bit and the bits before that
    byte, as 32-bit numbers; ``offset`` reads on from the nearest sample.
    """

    def __init__(self, n: int, low: int, low_bytes: np.ndarray, high_bytes: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.low_bytes, self.high_bytes, self.samples = n, low, low_bytes, high_bytes, samples

    @classmethod
    def encode(cls, offsets: np.ndarray) -> Boundaries:
        offsets = np.asarray(offsets, np.int64)
        n, top = len(offsets), int(offsets[-1])
        if top >= 1 << 32:
            raise ValueError("a file holds less than 2^32 ids")
        low = max(0, (top // n).bit_length() - 1)
        bits = ((offsets[:, None] >> np.arange(low)) & 1).astype(np.uint8)
        at = (offsets >> low) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1, np.uint8)
        high[at] = 1
        high_bytes = np.packbits(high, bitorder="little")
        first = at[::SAMPLE] >> 3
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high_bytes), dtype=np.int64)])[first]
        samples = np.stack([first, before], 1).astype(np.uint32).ravel()
        return cls(n, low, np.packbits(bits.ravel(), bitorder="little"), high_bytes, samples)

    def offset(self, i: int) -> int:
        """Offset i, from the nearest sample and the bytes after it."""
        at, seen = (int(x) for x in self.samples[2 * (i // SAMPLE):2 * (i // SAMPLE) + 2])
        while True:
            byte = int(self.high_bytes[at])
            if seen + byte.bit_count() > i:
                break
            seen, at = seen + byte.bit_count(), at + 1
        bit = -1
        for _ in range(i - seen + 1):
            bit += 1
            while not byte >> bit & 1:
                bit += 1
        value = at * 8 + bit - i
        lows = 0
        for k in range(self.low):
            p = self.low * i + k
            lows |= (int(self.low_bytes[p >> 3]) >> (p & 7) & 1) << k
        return value << self.low | lows

    def offsets(self) -> np.ndarray:
        """All offsets at once."""
        at = np.flatnonzero(np.unpackbits(self.high_bytes, bitorder="little"))[:self.n]
        bits = np.unpackbits(self.low_bytes, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
        return (at - np.arange(self.n) << self.low) + (bits.astype(np.int64) << np.arange(self.low)).sum(1)


def pack_file(ids: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    """One file: header, select samples, high and low parts of the boundaries, ids of ``width`` bytes each."""
    b = Boundaries.encode(np.concatenate([[0], np.cumsum(lengths)]))
    head = struct.pack(HEADER, MAGIC, len(lengths), len(ids), width, b.low, len(b.low_bytes), len(b.high_bytes), len(b.samples))
    return b"".join([head, b.samples.astype("<u4").tobytes(), b.high_bytes.tobytes(), b.low_bytes.tobytes(),
                     ids.astype(f"<u{width}").tobytes()])


def open_file(data: bytes) -> tuple[Boundaries, np.ndarray]:
    """Boundaries and ids of one file."""
    magic, docs, count, width, low, n_low, n_high, n_samples = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize(HEADER)
    samples = np.frombuffer(data, "<u4", n_samples, at)
    at += 4 * n_samples
    high = np.frombuffer(data, np.uint8, n_high, at)
    at += n_high
    lows = np.frombuffer(data, np.uint8, n_low, at)
    at += n_low
    return Boundaries(docs + 1, low, lows, high, samples), np.frombuffer(data, f"<u{width}", count, at)


ID = attrgetter("id")
CUT = "\uffff"  # stands between pieces while a text is split
#: Marks that may follow a word and then are a run of their own to the tokenizer (no apostrophe).
MARKS = ".,;:!?*#&$%|()-"


def pieces_of(text: str) -> list[str]:
    """Cut before each space and line feed. Safe pieces end in a visible character: the tokenizer never joins across such a cut."""
    return text.replace(" ", CUT + " ").replace("\n", CUT + "\n").split(CUT)


def unsafe(piece: str) -> bool:
    return not piece or piece[-1].isspace()


def joined_pieces(text: str) -> list[str]:
    """The same, with each unsafe piece joined to the next."""
    out, open_ = [], True
    for w in re.split(r"(?=[ \n])", text):
        if open_ and out:
            out[-1] += w
        else:
            out.append(w)
        open_ = unsafe(out[-1])
    return out


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """Encodes many texts with a byte-level BPE; equal pieces are encoded once and kept, about ``keep`` of them.

    When there are more, those that came up in one call only go, and the rarer ones of over ``keep`` / 2 others.

    A word, perhaps with a space before and marks after it, goes to the tokenizer's model directly; any other piece
    goes through the whole tokenizer.
    """

    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = dict(enumerate(byte_letters()))
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.calls = np.zeros(1 << 12, np.int32)
        self.used = 0

    def _make_room(self) -> None:
        if len(self.number) <= self.keep:
            return
        calls = self.calls[:len(self.number)]
        again = np.flatnonzero(calls > 1)
        again = np.sort(again[np.argsort(-calls[again], kind="stable")[:self.keep // 2]])
        pieces = np.fromiter(self.number, object, len(self.number))[again].tolist()
        lengths = self.length[again]
        flat = self.flat[ragged(self.start[again], lengths)]
        self.clear()
        self._hold(pieces, flat, lengths)

    def _run(self, text: str) -> Iterator[int]:
        """Ids of a text that is one run to the tokenizer."""
        return map(ID, self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(self.letters)))

    def _add(self, new: list[str]) -> None:
        words: list[str] = []
        others: list[str] = []
        flat: list[int] = []
        sizes: list[int] = []
        ends: dict[str, list[int]] = {}
        split, space = self.tokenizer.model.tokenize, self.letters[32]
        for p in new:
            core = p.rstrip(MARKS)
            word = core[1:] if core[:1] == " " else core
            if word.isalpha():
                before = len(flat)
                # ASCII letters stand for themselves.
                flat.extend(map(ID, split(word if word is core else space + word)) if word.isascii() else self._run(core))
                if len(core) < len(p):
                    end = p[len(core):]
                    if end not in ends:
                        ends[end] = list(self._run(end))
                    flat += ends[end]
                words.append(p)
                sizes.append(len(flat) - before)
            else:
                others.append(p)
        new = words + others
        for e in self.tokenizer.encode_batch(others, add_special_tokens=False):
            flat += e.ids
            sizes.append(len(e.ids))
        lengths = np.array(sizes, np.int64)
        ids = np.array(flat, np.int32)
        self._hold(new, ids, lengths)

    def _hold(self, new: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.number)
        if n + len(new) > len(self.start):
            grown = 3 * (n + len(new)) // 2
            self.start, self.length, self.calls = (np.resize(x, grown) for x in (self.start, self.length, self.calls))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 3 * (self.used + len(ids)) // 2)
        self.start[n:n + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.length[n:n + len(new)] = lengths
        self.calls[n:n + len(new)] = 0
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.number.update(zip(new, range(n, n + len(new))))

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that are kept as they are."""
        self._make_room()
        self._add(list(set(pieces).difference(self.number)))
        numbers = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        self.calls[numbers] += 1
        lengths = self.length[numbers]
        return self.flat[ragged(self.start[numbers], lengths)], lengths

    def _numbers(self, texts: list[str | None], whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces in a row, and the pieces of each text; ``whole`` joins unsafe pieces to the next."""
        lists = [[] if not t else joined_pieces(t) if whole else pieces_of(t) for t in texts]
        counts = np.array([len(x) for x in lists], np.int64)
        self._add(list(set().union(*lists).difference(self.number)))
        return np.fromiter(map(self.number.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum())), counts

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text.

        Texts are cut, and equal pieces found, as Arrow columns: only the different pieces of a call become strings.
        """
        self._make_room()
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string())
        marked = pc.fill_null(pc.match_substring(column, CUT), False).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pc.replace_substring(pc.fill_null(column, ""), " ", CUT + " "), "\n", CUT + "\n")
        lists = pc.split_pattern(cut, CUT)
        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        bad = np.array([unsafe(p) for p in pieces], bool)
        code = coded.indices.to_numpy()
        # Texts with unsafe pieces, or with the cut mark itself, are cut one by one.
        owner = np.repeat(np.arange(len(counts)), counts)
        marked[owner[bad[code]]] = True
        plain = ~marked[owner]
        seen = np.zeros(len(pieces), bool)
        seen[code[plain]] = True
        at = np.flatnonzero(seen).tolist()
        known = [pieces[i] for i in at]
        self._add([p for p in known if p not in self.number])
        number = np.zeros(len(pieces), np.int64)
        number[at] = np.fromiter(map(self.number.__getitem__, known), np.int64, len(known))
        numbers = number[code]
        if marked.any():
            which = np.flatnonzero(marked)
            found, sizes = self._numbers(column.take(pa.array(which)).to_pylist(), True)
            every = np.concatenate([numbers[plain], found])
            starts, lengths = np.zeros(len(counts), np.int64), counts.copy()
            lengths[which] = sizes
            starts[~marked] = np.cumsum(counts[~marked]) - counts[~marked]
            starts[which] = int(plain.sum()) + np.cumsum(sizes) - sizes
            numbers, counts = every[ragged(starts, lengths)], lengths
        self.calls[numbers] += 1
        lengths = self.length[numbers]
        ids = self.flat[ragged(self.start[numbers], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)


def encoder(path: str) -> Encoder:
    kept = process_cache("encoders")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, ids_per_file: int = 1 << 20, width: int | None = None,
) -> None:
    """Encode every text, add ``end_id`` to each, and write them in ascending id order under ``path``.

    A file is one row ``(part, seq, doc_ids, n_ids, data)`` of a Parquet table, ``data`` being the complete
    file of ``pack_file``: so it goes through Spark's own committer to any store, and a lost executor leaves
    nothing half written. ``(part, seq)`` ascends with the ids. A file ends after the document with which it
    reaches ``ids_per_file`` ids; a longer document has a file of its own. Null texts are empty (only the
    end id), null ids come first, rows with one id in either order, other columns are ignored.
    """
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    width = width or (2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = seq = 0
        part = None

        def file() -> pa.RecordBatch:
            data = pack_file(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), width)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                 pa.array([[i for h in held for i in h[0]]], pa.list_(pa.int64())), pa.array([size], pa.int64()),
                 pa.array([data], pa.binary())], ["part", "seq", "doc_ids", "n_ids", "data"])

        for batch in slices(batches, 2 << 20):
            part = batch.column(2)[0].as_py()
            doc_ids = batch.column(0).to_pylist()
            ids, lengths = coder.encode(batch.column(1))
            ends = np.cumsum(lengths)
            full = np.full(len(ids) + len(lengths), end_id, np.int64)
            full[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
            lengths = lengths + 1
            ends = np.cumsum(lengths)
            a = 0
            while a < len(doc_ids):
                done = int(ends[a - 1]) if a else 0
                b = int(np.searchsorted(ends, done + max(1, ids_per_file - size))) + 1
                b = min(max(b, a + 1), len(doc_ids))
                held.append((doc_ids[a:b], full[done:int(ends[b - 1])], lengths[a:b]))
                size += int(ends[b - 1]) - done
                if size >= ids_per_file:
                    yield file()
                    held, size, seq = [], 0, seq + 1
                a = b
        if held:
            yield file()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    )
    files = ordered.mapInArrow(run, "part int, seq int, doc_ids array<bigint>, n_ids bigint, data binary")
    files.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over its ids as 32-bit little-endian.
    """
    files = spark.read.schema("part int, seq int, doc_ids array<bigint>, n_ids bigint, data binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 32 << 20):
            for row in batch.to_pylist():
                bounds, ids = open_file(row["data"])
                at = bounds.offsets()
                wide = ids.astype("<u4")
                crcs = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1]), pa.array(np.diff(at)),
                     pa.array(crcs, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part_at"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        files.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_seq_at"))
        .join(parts, "part").select("part", "seq", (F.col("_part_at") + F.col("_seq_at")).alias("_base"))
    )
    decoded = files.select("part", "seq", "doc_ids", "data").mapInArrow(
        run, "part int, seq int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return decoded.join(offsets, ["part", "seq"]).select(
        "doc_id", (F.col("_base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def documents_of(data: bytes, which: list[int]) -> list[np.ndarray]:
    """Ids of chosen documents of one file, through the select structure."""
    bounds, ids = open_file(data)
    return [ids[bounds.offset(i):bounds.offset(i + 1)] for i in which]


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, **options)
    return read_token_files(docs.sparkSession, path)
