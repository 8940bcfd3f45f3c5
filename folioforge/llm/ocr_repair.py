"""Problem 7: noise in text from scanned pages.

Method: skip-gram vectors are learned over all chunks; a rare word, frequent only where pages were read by ocr, is
linked to the frequent words it can have been misread from (equal glyph skeletons); where there are several, each occurrence is corrected to the one
that its neighbours in the text make most likely; running headers and page numbers are removed, broken words joined
and lines reflowed into paragraphs.

The vectors are those of skip-gram with negative sampling: word and context vectors that maximise the expected objective over the counts of all (word, neighbour) pairs of the
corpus. Counting reads every chunk, with partial sums per task. One task trains a model of fixed size on all pairs: each of the TRAINED most frequent words has a place of its own, as word
and as neighbour, and all other words lie by a hash in SHARED places. From its place's vectors each of the other words is then trained on its own pairs with all places, so every word has vectors of its own
(they do not depend on one another: only those that a choice asks for are made, and reach its chunk by a join). Counts are whole numbers, so the result does not depend on the order of tasks. A bounded core of
the vocabulary (CORE words) is sent to all tasks; every word outside it is resolved by a join, so nothing is dropped.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.texts import latest
from folioforge.plans.runtime import save_table

DIMENSIONS, WINDOW = 32, 2
#: Words trained together (the most frequent ones) and places that all others share in that; negative samples a pair, steps of training.
TRAINED, SHARED, NEGATIVES, STEPS = 8192, 1024, 5, 40
#: Weight of a candidate's log frequency beside its fit into the context.
PRIOR = 0.5
#: Words of the core vocabulary that is sent to all tasks (a bound, not the vocabulary).
CORE = 30_000
#: A word is suspect if it is this many times rarer, by chunk, in clean text than in ocr text, and a
#: misreading of another that is at least TIMES as frequent.
RARER, TIMES = 0.2, 2
#: A word in this many ocr chunks can be what was meant even if clean text lacks it.
LEARNT = 20
#: Words distinct within one task's memory before its partial sums are passed on.
HELD = 200_000
#: Cells of neighbours distinct within one task's memory before its partial sums are passed on.
CELLS = 3_000_000

# Glyphs and pairs of glyphs that are mistaken for one another, each written as the strokes that stand
# for its class (rn for m, vv for w, el for d and cl, ll for h, b, u, li, ii).
_GLYPHS = str.maketrans({
    "0": "o", "6": "o", "1": "l", "!": "l", "|": "l", "i": "l", "5": "s", "$": "s", "9": "g", "q": "g", "c": "e", "3": "e",
    "f": "t", "7": "t", "2": "z", "4": "a", "m": "rn", "w": "vv", "d": "el", "h": "ll", "b": "ll", "u": "ll", "8": "ll",
})
_STROKES = re.compile("l{3,}")
_EDGE = " \t.,;:?!()[]{}\"“”‘’'«»…*_|<>"
_HYPHENS = "-­‐‑¬"
_BROKEN = re.compile(r"([^\W_](?:[^\W_]|[-'’!|¨])*)[-­‐‑¬]$")
_NUMBER = re.compile(r"^(?:[-–—\[(|\s.·•~*]*)(?:(?:page|pg?|sida|sid|s)\b\.?\s*)?([0-9OoIlSsBbZzgq!|]{1,5})(?:\s*(?:of|av|/)\s*\d+)?(?:[-–—\])|\s.·•~*]*)$", re.I)
#: Characters that are no letters or digits, for a quick count of the others.
_PLAIN = str.maketrans("", "", " \t.,;:?()[]{}\"'«»“”‘’*_<>/\\-–—=+#&%~·•")
_DIGITS = str.maketrans({"O": "0", "o": "0", "I": "1", "l": "1", "!": "1", "|": "1", "S": "5", "s": "5", "B": "8", "b": "6", "Z": "2", "z": "2", "g": "9", "q": "9"})
_LEAD = re.compile(r"^[\W_]*(?:page\s*)?[0-9OIlSB!|]{1,4}(?:[\W_]+)(?=\S)", re.I)
_TAIL = re.compile(r"(?<=\S)(?:[\W_]+)(?:page\s*)?[0-9OIlSB!|]{1,4}[\W_]*$", re.I)


def _broken(line: str) -> re.Match | None:
    """The word that a line's last hyphen follows."""
    bare = line.rstrip()
    return _BROKEN.search(bare) if bare and bare[-1] in _HYPHENS else None


@lru_cache(maxsize=200_000)
def skeleton(word: str) -> str:
    """What is left of a word's letters if glyphs that are mistaken for one another are made equal."""
    plain = unicodedata.normalize("NFKD", word.lower())
    return _STROKES.sub("ll", "".join(c for c in plain if c.isalnum() or c in "!|$").translate(_GLYPHS))


def clean_word(token: str) -> str:
    """A token in lower case without outer punctuation; an exclamation mark at its start, or alone, may be a misread letter."""
    if token == "!":
        return token
    if len(token) > 2 and token[0] == "!" and token[1].isalpha():
        return "!" + token[1:].strip(_EDGE).lower()
    return token.strip(_EDGE).lower()


def _is_word(w: str) -> bool:
    return 1 < len(w) <= 40 and any(map(str.isalpha, w)) or w in ("a", "i", "å", "ö", "!")


def _latest_chunks(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(chunk_id, source_id, title, chapter, page_start, page_end, text, ocr) once per chunk whose latest row has a text; ocr by the page's latest attempt."""
    method = pages.where("source_id is not null and page_number is not null").groupBy(F.col("source_id").alias("s_"), F.col("page_number").alias("p_")).agg(F.max(F.struct("extracted_at", "extraction_method")).alias("m_"))
    once = latest(chunks, "chunk_id", "created_at", "source_id", "title", "chapter", "page_start", "page_end", "text").where("text is not null")
    joined = once.join(method, (F.col("source_id") == F.col("s_")) & (F.col("page_start") == F.col("p_")), "left")
    return joined.withColumn("ocr", F.coalesce(F.col("m_.extraction_method") == "ocr", F.lit(False))).drop("s_", "p_", "m_")


def word_table(texts: DataFrame) -> DataFrame:
    """(word, n_clean, n_ocr): chunks that hold each word, by kind of page. texts: (text, ocr)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, str | None] = {}
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            every = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[w] for w in every], pa.int64()) for c in counts)], ["word", "n_clean", "n_ocr"])

        for batch in batches:
            for text, ocr in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = set()
                for token in set(text.split()):
                    w = words.get(token, "")
                    if w == "":
                        w = clean_word(token)
                        w = words[token] = w if _is_word(w) else None
                    here.add(w)
                here.discard(None)
                counts[bool(ocr)].update(here)
            if len(words) > HELD:
                yield flush()
                words.clear()
                counts[0].clear()
                counts[1].clear()
        yield flush()

    partial = texts.select("text", "ocr").mapInArrow(run, "word string, n_clean bigint, n_ocr bigint")
    return partial.groupBy("word").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_ocr").alias("n_ocr"))


class Model(NamedTuple):
    """Vectors of the places: those of ``words`` come first, the shared ones after them; ``totals``: neighbours that stand around each."""

    words: list[str]
    vectors: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray


def place(word: str, number: dict[str, int], shared: int) -> int:
    """The place of a word: its own, or one of the shared ones behind those."""
    k = number.get(word)
    return len(number) + zlib.crc32(word.encode()) % shared if k is None else k


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def neighbour_counts(texts: DataFrame, trained: list[str], shared: int, window: int = WINDOW) -> DataFrame:
    """(word, cell, n): how often words stand within ``window`` words of each other, over all texts.

    Without word: the pairs of places a <= b, each pair of neighbours once, cell = a * (number of places) + b. With a word outside ``trained``: its neighbours by their place.
    """
    known_words = texts.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(trained)})  # at most TRAINED words
    own, size = len(trained), len(trained) + shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = known_words.value, {}
        names: list[str] = []  # words outside trained, by their number less ``own``
        places = list(range(own))
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        rare: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for parts, named in ((pairs, False), (rare, True)):
                if parts:
                    keys, n = _summed(parts)
                    word = pa.array(names, pa.string()).take(pa.array(keys // size)) if named else pa.nulls(len(keys), pa.string())
                    yield pa.RecordBatch.from_arrays([word, pa.array((keys % size if named else keys).astype(np.int32)), pa.array(n)], ["word", "cell", "n"])
                    parts.clear()

        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                stream: list[int] = []
                for text in whole.column(0).slice(start, 1000).to_pylist():
                    for token in text.split():
                        k = known.get(token)
                        if k is None:
                            w = clean_word(token)
                            k = number.get(w, -1)
                            if k < 0 and shared and _is_word(w):
                                k = own + len(names)
                                names.append(w)
                                places.append(place(w, number, shared))
                            known[token] = k
                        stream.append(k)
                    stream.extend((-1,) * window)
                ids = np.array(stream, dtype=np.int64)
                at = np.array([*places, -1], dtype=np.int64)[ids]  # the last one for no word
                cells, told = [], []
                for step in range(1, window + 1):
                    both = (ids[:-step] >= 0) & (ids[step:] >= 0)
                    a, b = at[:-step][both], at[step:][both]
                    cells.append(np.minimum(a, b) * size + np.maximum(a, b))
                    for word, beside in ((ids[:-step][both], b), (ids[step:][both], a)):
                        far = word >= own
                        told.append((word[far] - own) * size + beside[far])
                for parts, found in ((pairs, cells), (rare, told)):
                    keys, n = np.unique(np.concatenate(found), return_counts=True)
                    if len(keys):
                        parts.append((keys, n))
                    if len(parts) > 1 and sum(len(k) for k, _ in parts) > CELLS:
                        parts[:] = [_summed(parts)]
                if len(known) > HELD or any(len(p) == 1 and len(p[0][0]) > CELLS // 2 for p in (pairs, rare)):
                    yield from flush()
                    known.clear()
                    names.clear()
                    del places[own:]
        yield from flush()

    return texts.select("text").mapInArrow(run, "word string, cell int, n bigint").groupBy("word", "cell").agg(F.sum("n").alias("n"))


class _Adam:
    """Climbs by Adam's steps."""

    def __init__(self, x: np.ndarray):
        self.x, self.mean, self.square, self.step = x, np.zeros_like(x), np.zeros_like(x), 0

    def climb(self, grad: np.ndarray) -> None:
        self.step += 1
        self.mean = 0.9 * self.mean + 0.1 * grad
        self.square = 0.99 * self.square + 0.01 * grad**2
        self.x = self.x + 0.1 * (self.mean / (1 - 0.9**self.step)) / (np.sqrt(self.square / (1 - 0.99**self.step)) + 1e-6)


def skip_gram(counts: np.ndarray, dimensions: int = DIMENSIONS, negatives: int = NEGATIVES, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(word vectors, context vectors) of skip-gram with negative sampling on a matrix of counts (words x contexts), see ``skip_gram_cells``."""
    row, col = np.nonzero(counts)
    return skip_gram_cells(row, col, counts[row, col], counts.shape, dimensions, negatives, steps)


def skip_gram_cells(row: np.ndarray, col: np.ndarray, n: np.ndarray, shape: tuple[int, int], dimensions: int = DIMENSIONS, negatives: int = NEGATIVES, steps: int = STEPS, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(word vectors, context vectors) of skip-gram with negative sampling on the cells of a matrix of counts, in the order of their rows.

    The objective is the expected one: n log s(v u) for the pairs that occur and ``negatives`` times as many drawn contexts (by frequency to the power 0.75) as
    log s(-v u); rows are weighed down to the root of their size, so frequent words do not drown the others. Trained by Adam from a fixed start. Chances are held for ``block`` rows at a time.
    """
    total = np.bincount(row, weights=n, minlength=shape[0]).astype(np.float32)
    drawn = np.bincount(col, weights=n, minlength=shape[1]).astype(np.float32) ** 0.75
    drawn /= max(float(drawn.sum()), 1e-9)
    weight = 1 / np.sqrt(np.maximum(total, 1))
    negative = negatives * total * weight
    # the slope at a cell, divided by its column's drawn: pairs + share * (slope of the negative ones)
    at = ((row % block) * shape[1] + col).astype(np.int32)
    pairs = n.astype(np.float32) * weight[row] / drawn[col]
    share = pairs / negative[row]
    ends = np.searchsorted(row, range(0, shape[0] + block, block))
    rng = np.random.default_rng(17)
    words, contexts = (_Adam(rng.normal(0, 0.1, (size, dimensions)).astype(np.float32)) for size in shape)
    for _ in range(steps):
        across, scaled = np.ascontiguousarray(contexts.x.T), contexts.x * drawn[:, None]
        up, along = np.zeros_like(words.x), np.zeros_like(across)
        for k, start in enumerate(range(0, shape[0], block)):
            v = words.x[start : start + block]
            slope = -v @ across
            with np.errstate(over="ignore"):
                np.exp(slope, out=slope)
            slope += 1
            np.divide(-negative[start : start + block, None], slope, out=slope)
            cells = slice(ends[k], ends[k + 1])
            flat = slope.reshape(-1)
            flat[at[cells]] += pairs[cells] + share[cells] * flat[at[cells]]
            up[start : start + block] = slope @ scaled
            along += v.T @ slope
        words.climb(up)
        contexts.climb(along.T * drawn[:, None])
    return words.x, contexts.x


def learn_vectors(texts: DataFrame, words: DataFrame, trained: int | None = None, shared: int | None = None) -> tuple[Model, DataFrame]:
    """(the vectors of all places, trained in one task on counts over all texts; (word, cell, n) of the words with a shared place)."""
    trained, shared = trained or TRAINED, shared or SHARED
    top = [r["word"] for r in words.orderBy(F.desc(F.col("n_clean") + F.col("n_ocr")), "word").limit(trained).collect()]
    shared = shared if len(top) == trained else 0  # else every word has its own
    size = len(top) + shared
    cells = save_table(neighbour_counts(texts, top, shared), "neighbours")
    rare = cells.where("word is not null")
    if not top:
        return Model([], *(np.zeros((0, DIMENSIONS), np.float32) for _ in range(2)), np.zeros(0)), rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.float32)) for b in batches]
        cell, n = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.float32))
        row, col = cell // size, cell % size
        data = (*skip_gram_cells(row, col, n, (size, size)), np.bincount(row, weights=n, minlength=size))
        yield pa.RecordBatch.from_arrays([pa.array(range(3), pa.int32()), pa.array([x.tobytes() for x in data], pa.binary())], ["part", "data"])

    a, b = F.expr(f"cell div {size}").cast("int"), F.col("cell") % size
    ways = F.when(a == b, F.array(F.struct("cell", (2 * F.col("n")).alias("n")))).otherwise(F.array(F.struct("cell", "n"), F.struct((b * size + a).alias("cell"), "n")))
    mirrored = cells.where("word is null").select(F.explode(ways).alias("c")).select(F.col("c.cell").alias("cell"), F.col("c.n").alias("n"))
    got = {r["part"]: bytes(r["data"]) for r in mirrored.coalesce(1).sortWithinPartitions("cell").mapInArrow(run, "part int, data binary").collect()}  # of fixed size
    if not got:  # no cells: an empty partition may not be run
        return Model(top, *(np.zeros((size, DIMENSIONS), np.float32) for _ in range(2)), np.zeros(size)), rare
    return Model(top, *(np.frombuffer(got[k], np.float32).reshape(-1, DIMENSIONS) for k in (0, 1)), np.frombuffer(got[2], np.float64)), rare


def own_vectors(counts: np.ndarray, starts: np.ndarray, model: Model, negatives: int = NEGATIVES, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(word vectors, context vectors) of words (their counts beside all places, their own place): the objective of ``skip_gram_cells``, with the places' vectors held."""
    n, total = counts.astype(np.float32), counts.sum(1, keepdims=True).astype(np.float32)
    all_drawn = max(float((model.totals**0.75).sum()), 1e-9)
    drawn, share = (model.totals**0.75 / all_drawn).astype(np.float32), total**0.75 / all_drawn
    row, column = 1 / np.sqrt(np.maximum(total, 1)), (1 / np.sqrt(np.maximum(model.totals, 1))).astype(np.float32)
    out = []
    for start, others, positive, negative in (
        (model.vectors, model.contexts, n * row, negatives * total * row * drawn),
        (model.contexts, model.vectors, n * column, negatives * (model.totals * column).astype(np.float32) * share),
    ):
        adam, both = _Adam(start[starts]), positive + negative
        for _ in range(steps):
            with np.errstate(over="ignore"):
                adam.climb((positive - both / (1 + np.exp(-(adam.x @ others.T)))) @ others)
        out.append(adam.x.astype(np.float32))
    return out[0], out[1]


def _own_table(rare: DataFrame, asked: DataFrame, shared, batch: int = 32) -> DataFrame:
    """(word, v, u): the vectors of the words asked for that have a shared place. shared: broadcast (.., model)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value[-1]
        number, size = {w: k for k, w in enumerate(model.words)}, len(model.totals)
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                b = whole.slice(start, batch)
                words, counts = b.column(0).to_pylist(), np.zeros((b.num_rows, size), np.float32)
                for k, cells in enumerate(b.column(1).to_pylist()):
                    counts[k, [c["cell"] for c in cells]] = [c["n"] for c in cells]
                both = own_vectors(counts, np.array([place(w, number, size - len(number)) for w in words]), model)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([x.tobytes() for x in side], pa.binary()) for side in both)], ["word", "v", "u"])

    listed = rare.join(asked, "word", "leftsemi").groupBy("word").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    return listed.mapInArrow(run, "word string, v binary, u binary")


def _skeletons(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array([skeleton(w) for w in b.column(0).to_pylist()], pa.string())], ["word", "n_clean", "n_ocr", "skeleton"])

    return df.select("word", "n_clean", "n_ocr").mapInArrow(run, "word string, n_clean bigint, n_ocr bigint, skeleton string")


def corrections(words: DataFrame, clean_chunks: int, ocr_chunks: int) -> DataFrame:
    """(word, meant ARRAY<STRUCT<meant, m>>): suspect words and the frequent words, with their frequency, that each can have been misread from.

    All have the same glyph skeleton as the suspect; the most frequent first, then in the order of the alphabet. Several suspects of one skeleton with several known words are
    joined to all of these; words of one skeleton are few, as it keeps a word's length and most of its letters.
    """
    shaped = save_table(_skeletons(words), "words")
    clean_rate, ocr_rate = F.col("n_clean") / max(1, clean_chunks), F.col("n_ocr") / max(1, ocr_chunks)
    suspects = shaped.where((F.col("n_ocr") > 0) & (clean_rate < RARER * ocr_rate)).select("word", "skeleton", (F.col("n_clean") + F.col("n_ocr")).alias("n"))
    known = shaped.where((F.col("n_clean") > 1) & (clean_rate >= RARER * ocr_rate) | (F.col("n_ocr") >= LEARNT)).select(F.col("word").alias("meant"), "skeleton", (F.col("n_clean") + F.col("n_ocr")).alias("m"))
    linked = suspects.join(known, "skeleton").where((F.col("m") >= TIMES * F.col("n")) & (F.col("word") != F.col("meant")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "meant")))
    return linked.groupBy("word").agg(F.transform(listed, lambda e: F.struct(e["meant"].alias("meant"), (-e["m"]).alias("m"))).alias("meant"))


class Context:
    """Chooses among the words that one may have been misread from by its neighbours in the text."""

    def __init__(self, number: dict[str, int], model: Model, own: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
        """own: vectors of words without a place of their own."""
        self.number, self.model, self.own = number, model, own or {}

    def _vector(self, word: str, side: int) -> np.ndarray | None:
        k = self.number.get(word)
        return self.model[1 + side][k] if k is not None else self.own[word][side] if word in self.own else None

    def choose(self, candidates: list[tuple[str, int]], around: list[str]) -> str:
        """The candidate (word, frequency) that fits best; without known neighbours, or for words that never had any, frequency decides."""
        near = [u for w in around if (u := self._vector(w, 1)) is not None]
        if len(candidates) == 1 or not near:
            return candidates[0][0]
        told = np.sum(near, axis=0)

        def fit(c: tuple[str, int]) -> tuple[float, int]:
            v = self._vector(c[0], 0)
            return round((0.0 if v is None else float(v @ told)) + PRIOR * math.log(c[1]), 4), c[1]

        return max(candidates, key=fit)[0]


class Reader:
    """Finds noise in the lines of one chunk with a vocabulary: word -> None if known, else the word meant."""

    def __init__(self, core: dict[str, str | None]):
        self.core = core

    def furniture(self, lines: list[str], title: str | None, chapter: str | None, first: int | None, last: int | None) -> list[str | None]:
        """Per line ``header``, ``page_number`` or None."""
        heads = {skeleton(x) for x in (title, chapter) if x and len(skeleton(x)) > 2}
        # a skeleton is hardly ever shorter than three fifths of its letters; twelve more may be the page's number
        most = 12 + (1.1 * max(map(len, heads), default=0) + 2) / 0.6
        out: list[str | None] = []
        low, high = (first or 0) - 1, (last or first or 10**6) + 1
        for line in lines:
            bare = line.strip()
            kind = None
            if bare and len(bare) <= 160:
                m = _NUMBER.match(bare) if len(bare) <= 20 else None
                digits = m[1].translate(_DIGITS) if m else ""
                if m and any(map(str.isdigit, m[1])) and digits.isdigit() and low <= int(digits) <= high:
                    kind = "page_number"
                elif heads and (len(bare) <= most or len(bare.translate(_PLAIN)) <= most):
                    parts = {bare, _LEAD.sub("", bare), _TAIL.sub("", bare)}
                    shapes = {skeleton(p) for p in parts}
                    if shapes & heads or any(len(s) > 8 and _close(s, h) for s in shapes for h in heads):
                        kind = "header"
            out.append(kind)
        return out

    def breaks(self, lines: list[str], furniture: list[str | None], lookup) -> dict[int, tuple[int | None, str, str]]:
        """Line index -> (index of the line that goes on, left part, right token) of lines ending in a hyphen after a letter."""
        out = {}
        for i, line in enumerate(lines):
            if furniture[i]:
                continue
            m = _broken(line)
            if not m:
                continue
            nxt = next((j for j in range(i + 1, len(lines)) if furniture[j] is None and lines[j].strip()), None)
            right = lines[nxt].split()[0] if nxt is not None else ""
            out[i] = (nxt, m[1], right)
        return out

    def is_broken(self, left: str, right: str, mark: str, lookup) -> tuple[bool, str]:
        """(whether the hyphen only broke the word, the whole word as read)."""
        r = right.rstrip(_EDGE).lower()
        joined, kept = (left + r).lower(), f"{left}-{r}".lower()
        if not r:
            return not lookup(left.lower() + "-")[0], joined
        as_one, as_two = lookup(clean_word(joined)), lookup(clean_word(kept))
        if as_one[0] != as_two[0] or as_one[2] or as_two[2]:
            one, two = (as_one[0], as_one[2]), (as_two[0] or as_two[2] > 2, as_two[2])
            return one > two if one[0] == two[0] else one[0], joined if (one > two if one[0] == two[0] else one[0]) else kept
        if as_one[1] or as_two[1]:
            return bool(as_one[1]), joined if as_one[1] else kept
        both = lookup(left.lower())[0] and lookup(r)[0]
        return mark != "-" or not both, joined


def _close(a: str, b: str) -> bool:
    """Whether two skeletons of like length differ in at most an eighth of their places, end to end."""
    if abs(len(a) - len(b)) > max(1, len(b) // 10):
        return False
    prefix = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    suffix = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return prefix + suffix >= len(b) - max(1, len(b) // 8)


_COLS = "chunk_id string, title string, chapter string, page_start int, page_end int, text string"


def _lookups(lines: list[str], furniture: list[str | None]) -> set[str]:
    """All words whose entry the reading of a chunk may need."""
    out: set[str] = set()
    body = [(i, x) for i, x in enumerate(lines) if furniture[i] is None and x.strip()]
    for n, (_, line) in enumerate(body):
        tokens = line.split()
        out.update(map(clean_word, tokens))
        if m := _broken(line):
            left = m[1].lower()
            right = body[n + 1][1].split()[0].rstrip(_EDGE).lower() if n + 1 < len(body) else ""
            out.update((clean_word(left + right), clean_word(f"{left}-{right}"), left, left + "-", right))
    return {w for w in out if w}


def read_lines(text: str, title: str | None, chapter: str | None, first: int | None, last: int | None, vocabulary: dict[str, tuple[bool, list[tuple[str, int]] | None, int]], context: Context | None = None) -> tuple[list[tuple[int, str]], str]:
    """((line_no, noise) cases, repaired text) of one chunk. vocabulary: word -> (known, words that can be meant with their frequency, frequency)."""
    reader = Reader({})
    nothing = (False, None, 0)

    def lookup(w: str) -> tuple[bool, str | None, int]:
        known, meant, n = vocabulary.get(w, nothing)
        return known, meant[0][0] if meant else None, n

    def fitting(w: str, around: list[str]) -> str:
        meant = vocabulary.get(w, nothing)[1]
        return context.choose(meant, around) if context and len(meant) > 1 else meant[0][0]

    lines = text.split("\n")
    furniture = reader.furniture(lines, title, chapter, first, last)
    cases = [(i + 1, kind) for i, kind in enumerate(furniture) if kind]
    breaks = reader.breaks(lines, furniture, lookup)
    wrong: set[int] = set()
    replace_end: dict[int, str | None] = {}
    skip_first: set[int] = set()
    for i, (nxt, left, right) in breaks.items():
        mark = lines[i].rstrip()[-1]
        broken, whole = reader.is_broken(left, right, mark, lookup)
        if broken:
            cases.append((i + 1, "hyphen"))
        meant = None if lookup(clean_word(whole))[0] else lookup(clean_word(whole))[1]
        if meant:
            same = next((k for k, (x, y) in enumerate(zip(whole, meant)) if x != y), min(len(whole), len(meant)))
            at = i if same < len(left) or nxt is None else nxt
            wrong.add(at)
        if nxt is not None:
            tail = right[len(right.rstrip(_EDGE)) :]
            joined = _like(meant, left) + tail if meant else (left + ("" if broken else "-") + right)
            replace_end[i] = joined
            skip_first.add(nxt)
    out: list[str] = []
    flow, begins = [], {}  # the words of the body in order, and where each line's begin
    for i, line in enumerate(lines):
        if not furniture[i]:
            begins[i] = len(flow)
            flow.extend(line.split())
    for i, line in enumerate(lines):
        if furniture[i]:
            continue
        if not line.strip():
            out.append("")
            continue
        tokens = line.split()
        fixed = []
        for k, token in enumerate(tokens):
            if k == 0 and i in skip_first:
                continue
            if k == len(tokens) - 1 and i in breaks:
                head = token[: len(token.rstrip(_HYPHENS)) - len(breaks[i][1])] if i in replace_end else ""
                fixed.append(head + replace_end[i] if i in replace_end else token)
                continue
            w = clean_word(token)
            known, meant, _ = lookup(w)
            if meant and not known:
                wrong.add(i)
                at = begins[i] + k
                meant = fitting(w, [clean_word(x) for x in (*flow[max(0, at - WINDOW) : at], *flow[at + 1 : at + 1 + WINDOW])])
                at = token.lower().find(w)
                token = token[:at] + _like(meant, token[at : at + len(w)]) + token[at + len(w) :] if at >= 0 else token
            fixed.append(token)
        if fixed:
            out.append(" ".join(fixed))
    cases += [(i + 1, "misread") for i in wrong]
    paragraphs, part = [], []
    for x in [*out, ""]:
        if x:
            part.append(x)
        elif part:
            paragraphs.append(" ".join(part))
            part = []
    return sorted(set(cases)), "\n\n".join(paragraphs)


def _like(meant: str, seen: str) -> str:
    """A word with the capitals of what stood there."""
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(map(str.isupper, letters)):
        return meant.upper()
    return meant[:1].upper() + meant[1:] if seen[:1].isupper() else meant


def _read(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(chunk_id, lines ARRAY<INT>, noises ARRAY<STRING>, text) of each chunk from an ocr page."""
    every = save_table(_latest_chunks(chunks, pages), "chunks")
    spark = every.sparkSession
    sizes = {r["ocr"]: r["count"] for r in every.groupBy("ocr").count().collect()}
    words = save_table(word_table(every), "counts")
    n_clean, n_ocr = sizes.get(False, 0), sizes.get(True, 0)
    meant = corrections(words, n_clean, n_ocr)
    rate = (F.col("n_clean") / max(1, n_clean)) >= RARER * F.col("n_ocr") / max(1, n_ocr)
    known = rate & (F.col("n_clean") > 1)
    table = save_table(words.select("word", known.alias("known"), (F.col("n_clean") + F.col("n_ocr")).alias("n")).join(meant, "word", "left"), "vocabulary")
    core = {r["word"]: _entry(r) for r in table.orderBy(F.desc("n"), "word").limit(CORE).collect()}  # bounded by CORE
    model, rare = learn_vectors(every, words)
    shared = spark.sparkContext.broadcast((core, {w: k for k, w in enumerate(model.words)}, model))
    scanned = every.where("ocr").select("chunk_id", "title", "chapter", "page_start", "page_end", "text")
    reader = Reader({})

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, number, _ = shared.value
        open_ = {w for w, (known, meant, _) in core.items() if not known and meant and len(meant) > 1}
        for b in batches:
            ids, words_, beside = [], [], []
            for cid, title, chapter, first, last, text in zip(*(b.column(k).to_pylist() for k in range(6))):
                lines = text.split("\n")
                kinds = reader.furniture(lines, title, chapter, first, last)
                asked = {w for w in _lookups(lines, kinds) if w not in core or w in open_}
                if not asked:
                    continue
                flow = [clean_word(token) for line, kind in zip(lines, kinds) if not kind for token in line.split()]
                near: dict[str, set[str]] = defaultdict(set)
                for at, w in enumerate(flow):
                    if w in asked:
                        near[w].update(x for x in (*flow[max(0, at - WINDOW) : at], *flow[at + 1 : at + 1 + WINDOW]) if x not in number and _is_word(x))
                for w in asked:
                    inside = w in core  # its entry is at hand, its candidates' vectors may not be
                    others = near[w] | {m for m, _ in core[w][1] if m not in number} if inside else near[w]
                    if others or not inside:
                        ids.append(cid)
                        words_.append(None if inside else w)
                        beside.append(sorted(others))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words_, pa.string()), pa.array(beside, pa.list_(pa.string()))], ["chunk_id", "word", "near"])

    asked = save_table(scanned.mapInArrow(wanted, "chunk_id string, word string, near array<string>").join(table, "word", "left").where("known is not null or word is null"), "asked")
    entries = asked.where("word is not null").groupBy("chunk_id").agg(F.collect_list(F.struct("word", "known", "meant", "n")).alias("more"))
    # words whose vectors a choice needs, as far as they have no place of their own: neighbours and candidates
    choices = asked.where("word is null or not known and size(meant) > 1").select("chunk_id", F.explode(F.array_union("near", F.coalesce(F.col("meant.meant"), F.array().cast("array<string>")))).alias("word")).distinct()
    own = _own_table(rare, choices.select("word").distinct(), shared)
    told = choices.join(own, "word").groupBy("chunk_id").agg(F.collect_list(F.struct("word", "v", "u")).alias("told"))
    joined = scanned.join(entries, "chunk_id", "left").join(told, "chunk_id", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, number, model = shared.value
        for b in batches:
            ids, nos, kinds, texts = [], [], [], []
            for cid, title, chapter, first, last, text, more, told in zip(*(b.column(k).to_pylist() for k in range(8))):
                own = _Layered(core, {e["word"]: _entry(e) for e in more or ()})
                context = Context(number, model, {e["word"]: (np.frombuffer(e["v"], np.float32), np.frombuffer(e["u"], np.float32)) for e in told or ()})
                cases, repaired = read_lines(text, title, chapter, first, last, own, context)
                ids.append(cid)
                nos.append([c[0] for c in cases])
                kinds.append([c[1] for c in cases])
                texts.append(repaired)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nos, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], ["chunk_id", "lines", "noises", "text"])

    return joined.select("chunk_id", "title", "chapter", "page_start", "page_end", "text", "more", "told").mapInArrow(read, "chunk_id string, lines array<int>, noises array<string>, text string")


def _entry(r) -> tuple[bool, list[tuple[str, int]] | None, int]:
    return r["known"], [(e["meant"], e["m"]) for e in r["meant"]] if r["meant"] else None, r["n"]


class _Layered:
    """A chunk's own entries before the core's."""

    def __init__(self, core: dict, own: dict):
        self.core, self.own = core, own

    def get(self, word: str, default):
        return self.own.get(word) or self.core.get(word, default)


def noise_lines(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(chunk_id, line_no, noise): hyphen, header, page_number and misread lines of chunks whose page page_start was last read by ocr.

    A chunk counts once, by its latest row; null texts, chunks without page and pages without metadata are left out; empty tables give no
    rows. A line may be a case of several kinds. line_no counts from 1, lines end in a line feed.
    """
    both = _read(chunks, pages).select("chunk_id", F.explode(F.arrays_zip("lines", "noises")).alias("c"))
    return both.select("chunk_id", F.col("c.lines").alias("line_no"), F.col("c.noises").alias("noise"))


def repaired_texts(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(chunk_id, text): the texts of the same chunks in whole paragraphs, without page furniture, misread words corrected."""
    return _read(chunks, pages).select("chunk_id", "text")
