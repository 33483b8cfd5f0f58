"""Language identification: per-language piece unigrams, all segmentations of a word summed."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.common import give_back, remainder, slices, texts_of
from vecloom.plans.scratch import stored

LETTERS = r"[^\W\d_]+"
START = "▁"
#: Letters of a run that are worked on at once; longer runs go on from the sums of the piece before.
PIECE = 1024


def pieces_of_model(path: str, longest: int) -> dict[str, int]:
    """Pieces of a SentencePiece vocabulary of up to ``longest`` characters, numbered from 2."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i).lower() for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    out: dict[str, int] = {}
    for n in names:
        if 0 < len(n) <= longest and n not in out:
            out[n] = len(out) + 2
    return out


class Lattice:
    """All ways to cut words into pieces. Number 0: no piece (never used); 1: a single character that is no piece.

    Pieces are found through a 64-bit rolling hash of their characters in a direct table with a second one for
    the slots that are taken twice.
    """

    BASE, SLOTS = np.uint64(0x9E3779B97F4A7C15), 20

    def __init__(self, pieces: dict[str, int], longest: int):
        self.longest, self.size = longest, len(pieces) + 2
        self.tables = []
        left = {int(self._hash(np.array([[ord(c) for c in p]], np.uint64))[0]): n for p, n in pieces.items()}
        if len(left) != len(pieces):
            raise ValueError("two pieces of the vocabulary share a hash")
        for multiplier in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            multiplier = np.uint64(multiplier)
            keys, numbers = np.zeros(1 << self.SLOTS, np.uint64), np.zeros(1 << self.SLOTS, np.int32)
            missed = {}
            for h, n in left.items():
                at = (h * int(multiplier) & (1 << 64) - 1) >> (64 - self.SLOTS)
                if numbers[at]:
                    missed[h] = n
                else:
                    keys[at], numbers[at] = h, n
            if numbers.any():
                self.tables.append((multiplier, keys, numbers))
            left = missed
        if left:
            raise ValueError("the vocabulary does not fit the tables")

    def _hash(self, chars: np.ndarray) -> np.ndarray:
        h = np.zeros(len(chars), np.uint64)
        for j in range(chars.shape[1]):
            h = h * self.BASE + chars[:, j] + np.uint64(1)
        return h

    def spans(self, n: int) -> list[tuple[int, int]]:
        return [(i, j) for j in range(1, n + 1) for i in range(max(0, j - self.longest), j)]

    def numbers(self, words: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
        """Piece number of every span of words of one length."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)
        n = chars.shape[1]
        where = {span: k for k, span in enumerate(spans)}
        out = np.empty((len(words), len(spans)), np.int32)
        h = np.zeros((len(words), n + 1), np.uint64)
        for size in range(1, min(n, self.longest) + 1):
            h = h[:, :-1] * self.BASE + chars[:, size - 1:] + np.uint64(1)
            found = np.full(h.shape, 1 if size == 1 else 0, np.int32)
            for multiplier, keys, numbers in self.tables:
                at = h * multiplier >> np.uint64(64 - self.SLOTS)
                found = np.where((keys[at] == h) & (numbers[at] > 0), numbers[at], found)
            out[:, [where[i, i + size] for i in range(n - size + 1)]] = found
        return out

    def forward(self, p: np.ndarray, n: int, before: tuple[list, list] | None = None) -> tuple[list, list]:
        """Sums of the first j characters, each row scaled to a maximum of 1, and the logs of these scales.

        With ``before``, the sums and scales of the first characters are known and ``p`` holds the spans that end after them.
        """
        rows = p.shape[:1] + p.shape[2:]
        sums, scale = (list(x) for x in before or ([np.ones(rows)], [np.zeros(rows[0])]))
        at = 0
        for j in range(len(sums), n + 1):
            total = np.zeros(rows)
            for i in range(max(0, j - self.longest), j):
                step = sums[i] * p[:, at]
                if i < j - 1:
                    step *= np.exp(scale[i] - scale[j - 1])[:, None]
                total += step
                at += 1
            top = total.max(1)
            sums.append(total / top[:, None])
            scale.append(scale[j - 1] + np.log(top))
        return sums, scale

    def long_marginal(self, word: str, prob: np.ndarray, piece: int) -> np.ndarray:
        """The same sum for one word, ``piece`` characters at a time; each piece starts from the last sums of the one before."""
        known, begin, kept = None, 0, 0
        while begin + kept < len(word):
            part = word[begin:begin + kept + piece]
            spans = self.spans(len(part))
            p = prob[self.numbers([part], spans)[:, len(self.spans(kept)):]]
            sums, scale = self.forward(p, len(part), known)
            begin, kept = begin + len(part) - (self.longest - 1), self.longest - 1
            known = sums[-self.longest:], scale[-self.longest:]
        return np.log(np.maximum(sums[-1][0], 1e-300)) + scale[-1][0]

    def log_marginals(self, words: list[str], prob: np.ndarray, step: int = 2048, piece: int = PIECE) -> np.ndarray:
        """log P(word) under every language, summed over all segmentations: ``(words, languages)``."""
        out = np.zeros((len(words), prob.shape[1]))
        for n, at in self.by_length(words):
            if n > max(piece, self.longest):
                for i in at:
                    out[i] = self.long_marginal(words[i], prob, max(piece, self.longest))
                continue
            spans = self.spans(n)
            size = max(1, step * 16 // n)
            for a in range(0, len(at), size):
                part = at[a:a + size]
                p = prob[self.numbers([words[i] for i in part], spans)]
                sums, scale = self.forward(p, n)
                out[part] = np.log(np.maximum(sums[n], 1e-300)) + scale[n][:, None]
        return out

    def expected(self, words: list[str], counts: np.ndarray, langs: np.ndarray, prob: np.ndarray, out: np.ndarray, step: int = 2048) -> None:
        """Add to ``out[piece, language]`` how often each piece is expected in the words of a language."""
        for n, at in self.by_length(words):
            spans = self.spans(n)
            size = max(1, step * 16 // n)
            for a in range(0, len(at), size):
                part = at[a:a + size]
                ids = self.numbers([words[i] for i in part], spans)
                lang = langs[part]
                p = prob[ids, lang[:, None]][:, :, None]
                sums, scale = self.forward(p, n)
                # The same from the end, in the scales of the forward sums: back[j] is P(rest after j) * exp(scale[j] - scale[n]).
                back = [np.zeros(len(part))] * n + [1.0 / sums[n][:, 0]]
                weight = np.empty((len(part), len(spans)))
                starts = [[] for _ in range(n)]
                for k, (i, j) in enumerate(spans):
                    starts[i].append((k, j))
                for i in range(n - 1, -1, -1):
                    total = np.zeros(len(part))
                    for k, j in starts[i]:
                        step_back = p[:, k, 0] * back[j] * np.exp(scale[i] - scale[j])
                        weight[:, k] = step_back * sums[i][:, 0]
                        total += step_back
                    back[i] = total
                weight *= counts[part][:, None]
                key = ids.astype(np.int64) * out.shape[1] + lang[:, None]
                out += np.bincount(key.ravel(), weight.ravel(), out.size).reshape(out.shape)

    @staticmethod
    def by_length(words: list[str]) -> list[tuple[int, np.ndarray]]:
        lengths = np.array([len(w) for w in words], np.int64)
        return [(int(n), np.flatnonzero(lengths == n)) for n in np.unique(lengths)]


#: ASCII upper case to lower case, all other ASCII that is no letter to a space.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def raw_words(text: bytes | None) -> list[bytes]:
    """A text cut at everything in ASCII that is no letter."""
    return text.translate(FOLD).split() if text else []


def runs_of(word: bytes, cut) -> list[str]:
    """The runs of letters of a raw word, lower-cased; what merely counts as a letter, such as a fraction, is left out."""
    if word.isascii():
        return [word.decode()]
    return [r for r in cut(word.decode(errors="replace").lower()) if any(c.isalpha() for c in r)]


def learn(
    docs: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang",
    rounds: int = 2, longest: int = 8, smoothing: float = 0.01, max_languages: int = 500,
) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each piece in each, by expectation maximisation over all given rows.

    Words are counted per input task and language first; each round then reads only these counts.
    A pass returns at most pieces x languages numbers, whatever the input; more than ``max_languages``
    different values are an error. Rows without text or language teach nothing. Here a run of over ``PIECE`` letters
    counts as several: it is cut after every ``PIECE`` letters. Counts leave a task after 64 MB of text at the latest.
    """
    named = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back("encoders")
        cut = re.compile(LETTERS).findall
        seen: dict[str, Counter] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, raw in seen.items():
                c: Counter = Counter()
                for w, n in raw.items():
                    for r in runs_of(w, cut):
                        c[START + r[:PIECE]] += n
                        for a in range(PIECE, len(r), PIECE):
                            c[r[a:a + PIECE]] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())],
                    ["lang", "word", "n"])
            seen.clear()

        for batch in slices(batches):
            for text, lang in zip(texts_of(batch), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(raw_words(text))
            held += batch.nbytes
            if held > 64 << 20 or sum(map(len, seen.values())) > 400_000:
                yield from flush()
                held = 0
        yield from flush()

    words = stored(named.mapInArrow(count, "lang string, word string, n bigint"), "words")
    found = words.select("lang").distinct().limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    langs = sorted(r.lang for r in found)
    pieces = pieces_of_model(vocabulary, longest)
    size = len(pieces) + 2
    prob = np.full((size, len(langs)), 1.0 / size)
    prob[0] = 0.0
    for _ in range(rounds if langs else 0):
        sent = words.sparkSession.sparkContext.broadcast((pieces, prob, {x: i for i, x in enumerate(langs)}))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            give_back("encoders")
            pieces, prob, number = sent.value
            lattice = Lattice(pieces, longest)
            out = np.zeros_like(prob)
            for batch in batches:
                lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
                text = batch.column(1).to_pylist()
                lattice.expected(text, batch.column(2).to_numpy().astype(float), lang, prob, out)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.ravel()[at])], ["cell", "n"])

        sums = words.mapInArrow(expect, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(prob.size)
        counts[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
        counts = counts.reshape(prob.shape) + smoothing
        counts[0] = 0.0
        prob = counts / counts.sum(0)
    return langs, prob


def identify(
    docs: DataFrame, langs: list[str], prob: np.ndarray, vocabulary: str,
    id_col: str = "doc_id", text_col: str = "text", longest: int = 8, keep: list[str] | None = None,
) -> DataFrame:
    """``(doc_id, lang_pred, score)``, one row per input row, repeated ids included; with ``keep`` these columns instead of the id.

    The score is the probability of the best language among all, each equally likely beforehand; ties go
    to the first by name. ``und`` with score 0 if the text is null or has no letter, or nothing was learned. A run of
    letters of any length is summed over all its segmentations, in pieces, so a text without spaces takes no more memory.
    """
    pieces = pieces_of_model(vocabulary, longest)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, prob))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back("encoders")
        pieces, prob = sent.value
        lattice = Lattice(pieces, longest)
        cut = re.compile(LETTERS).findall
        number: dict[str, int] = {}
        logs, held = np.zeros((1 << 14, len(langs))), 0
        for batch in slices(batches, 2 << 20):
            if len(number) > 400_000 or held > 32 << 20:
                number.clear()
                held = 0
            lists = [raw_words(t) for t in texts_of(batch, name)]
            new = list(set().union(*lists).difference(number))
            held += sum(map(len, new))
            first = len(number)
            if first + len(new) > len(logs):
                logs = np.concatenate([logs, np.zeros((first + 2 * len(new), len(langs)))])
            if new:
                runs = [runs_of(w, cut) for w in new]
                each = lattice.log_marginals([START + r for x in runs for r in x], prob)
                count = np.array([len(x) for x in runs])
                sums = np.concatenate([np.zeros((1, len(langs))), np.cumsum(each, 0)])[np.concatenate([[0], np.cumsum(count)])]
                logs[first:first + len(new)] = np.where(count[:, None] > 0, np.diff(sums, axis=0), np.nan)
            number.update(zip(new, range(first, first + len(new))))
            ends = np.cumsum([0] + [len(x) for x in lists])
            look = number.__getitem__
            each = logs[np.fromiter(map(look, chain.from_iterable(lists)), np.int64, int(ends[-1]))]
            useful = ~np.isnan(each[:, 0]) if len(langs) else np.zeros(len(each), bool)
            total = np.concatenate([np.zeros((1, len(langs))), np.cumsum(np.where(useful[:, None], each, 0.0), 0)])
            known = np.concatenate([[0], np.cumsum(useful)])
            names, scores = [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if known[b] == known[a]:
                    names.append("und")
                    scores.append(0.0)
                    continue
                ll = total[b] - total[a]
                best = int(ll.argmax())
                names.append(langs[best])
                scores.append(float(1.0 / np.exp(ll - ll[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:shown_n], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[:shown_n], "lang_pred", "score"])

    shown = [F.col(id_col).cast("long").alias("doc_id")] if keep is None else [F.col(c) for c in keep]
    shown_n, name = len(shown), text_col if text_col in (keep or ()) else "_text"
    rows = docs.select(*shown) if name == text_col else docs.select(*shown, F.col(text_col).alias(name))
    schema = T.StructType(rows.schema.fields[:shown_n]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def language_of(docs: DataFrame, vocabulary: str, folds: int = 5, rounds: int = 2) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learned on the rows with crc32(id) mod ``folds`` not 0, given to all."""
    langs, prob = learn(docs.where(remainder("doc_id", folds) != 0), vocabulary, rounds=rounds)
    return identify(docs, langs, prob, vocabulary).select(
        "doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score")
