"""Problem 10: the subject areas of each document.

Method: one-versus-rest linear (logistic) classifiers on hashed word one- and two-grams. They are
trained on weak labels: a request's subjects are those named in the path of its address, among its tags or by its collection (the site's sections); the
sentences of its body inherit them, and in a second round only those sentences that the first
model does not contradict. People's labels of documents join the training rows and calibrate one threshold per
subject. A document's sentences or entries are classified one by one, with some weight for its
paragraph; subjects with a quarter of them or more are the document's.

Only the training rows are a bounded sample (SAMPLE, LABELLED, UNITS); every document is classified whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.quality import COMMON, batch_stats
from folioforge.llm.texts import latest
from folioforge.plans.runtime import fan_out, save_table

BUCKETS = 1 << 17
#: Bounds of the training sample: weakly labelled requests, documents labelled by people, and sentences of both.
SAMPLE, LABELLED, UNITS = 3000, 1500, 200_000
EPOCHS, RATE, DECAY = 16, 0.5, 1e-5
#: Share of a document's sentences or entries from which on a subject is the document's.
SHARE = 0.25
#: Weight of the paragraph's and of the document's mean score in the score of a sentence.
PARAGRAPH, DOCUMENT = 0.35, 0.15
#: A sentence says nothing of a subject if its best score leads the next by less; a document is not read
#: at all if fewer of its sentences than LEAST say something.
MARGIN, LEAST = 1.6, 0.2
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)\]]?\s+(?=[\"'“«(]?[^\W\d_a-zåäöéüß])")
_SKIP = re.compile(r"(?:<!--.*-->\s*$|#{1,6}\s|```|[|:\-=+*_\s]+$)")
_ENTRY = re.compile(r"(?:[-*+•·‣◦▪–—]|\[[ xX]?\]|\(?\d{1,4}[.)]|\(?[A-Za-z][.)])\s+\S|.*(?:\||\t|\S {2,}\S|\.{4,}|[^\s,;][,;][^\s,;]| / )|[^:.!?]{1,40}:\s+\S+(?:\s+\S+){0,4}$")
_END = re.compile(r"[.!?][\"'”’»)\]]*\s*$")


def units_of(text: str) -> list[list[str]]:
    """Sentences or entries of a text by paragraph; headings, markers and fenced code are left out."""
    out: list[list[str]] = []
    block: list[str] = []
    fenced = False

    def close() -> None:
        if block:
            entries = sum(bool(_ENTRY.match(x)) for x in block)
            stops = sum(bool(_END.search(x)) for x in block)
            if len(block) > 1 and (2 * entries >= len(block) and 2 * stops < len(block) or len(block) > 3 and not stops and max(map(len, block)) < 34):
                out.append(list(block))
            else:
                parts = _SENTENCE.split(" ".join(block))
                out.append([p for p in parts if p])
            block.clear()

    for line in map(str.strip, text.splitlines()):
        if not line:
            close()
        elif line.startswith("```"):
            close()
            fenced = not fenced
        elif fenced or _SKIP.match(line):
            close()
        else:
            block.append(line)
    close()
    return out


def unreadable(texts: list[str | None]) -> list[bool]:
    """Which texts are junk by the quality rules; those are applied only where function words are rare, to all such texts at once."""

    def rare(text: str | None) -> bool:
        words = _WORD.findall((text or "").lower())
        return not (words and sum(map(COMMON.__contains__, words)) >= 0.08 * len(words) and sum(map(len, words)) >= 3 * len(words))

    doubtful = [i for i, t in enumerate(texts) if t and rare(t)]
    out = [False] * len(texts)
    for i, form in zip(doubtful, batch_stats(pa.array([texts[i] for i in doubtful], pa.string()))["doc_form"]):
        out[i] = form == "junk"
    return out


class Hasher:
    """Hashed one- and two-grams of a sentence, with memory of words."""

    def __init__(self) -> None:
        self.memory: dict[str, int] = {}

    def __call__(self, unit: str) -> list[int]:
        memory, out, before = self.memory, [], 0
        if len(memory) > 300_000:
            memory.clear()
        for w in _WORD.findall(unit.lower()):
            h = memory.get(w)
            if h is None:
                h = memory[w] = xxhash.xxh32_intdigest(w)
            out.append(h % BUCKETS)
            if before:
                out.append((before * 31 + h) % 4294967291 % BUCKETS)
            before = h
        return list(set(out)) if len(out) > 40 else out


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    return np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(sizes.sum())), sizes


def _scores(weights: np.ndarray, bias: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Linear scores of units given as hashed grams; grams weigh 1 / sqrt(their number)."""
    out = np.zeros((len(sizes), weights.shape[1]), dtype=np.float32)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] = np.add.reduceat(weights[flat], starts, axis=0) / np.sqrt(sizes[some])[:, None]
    return out + bias


class _Block:
    """A block of units laid out once for all epochs: its grams, whose units they belong to, and an order in which equal grams stand together."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, target: np.ndarray):
        self.sizes, self.target = sizes, target
        self.weight = (1 / np.sqrt(np.maximum(sizes, 1))).astype(np.float32)[:, None]
        unit = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(flat, kind="stable")
        self.seen, self.first = np.unique(flat[order], return_index=True)
        self.unit, self.place = unit[order], np.searchsorted(self.seen, flat)
        self.starts = np.cumsum(sizes) - sizes

    def scores(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.seen][self.place], self.starts, axis=0) * self.weight + bias


def _fit(flat: np.ndarray, sizes: np.ndarray, target: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-rest logistic regression by AdaGrad over blocks of units; target is units x n in [0, 1], every unit has grams."""
    weights, bias = np.zeros((BUCKETS, n), dtype=np.float32), np.full(n, -2.0, dtype=np.float32)
    history, history_b = np.full((BUCKETS, n), 1e-3, dtype=np.float32), np.full(n, 1e-3, dtype=np.float32)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    rng = np.random.default_rng(5)
    blocks = [_Block(flat[ends[i] : ends[min(i + 4096, len(sizes))]], sizes[i : i + 4096], target[i : i + 4096]) for i in range(0, len(sizes), 4096)]
    for _ in range(EPOCHS):
        for k in rng.permutation(len(blocks)):
            b = blocks[k]
            p = 1 / (1 + np.exp(-b.scores(weights, bias)))
            slope = (p - b.target).astype(np.float32) / np.float32(math.sqrt(len(b.sizes)))
            grad = np.add.reduceat((slope * b.weight)[b.unit], b.first, axis=0) + DECAY * weights[b.seen]
            history[b.seen] += grad**2
            weights[b.seen] -= RATE * grad / np.sqrt(history[b.seen])
            gb = slope.sum(0) / len(b.sizes)
            history_b += gb**2
            bias -= 0.1 * gb / np.sqrt(history_b)
    return weights, bias


def _paragraph_means(raw: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    sums = np.zeros((int(paragraph[-1]) + 1, raw.shape[1]), dtype=np.float32)
    np.add.at(sums, paragraph, raw)
    return (sums / np.bincount(paragraph)[:, None])[paragraph]


def unit_scores(text: str | None, hasher: Hasher, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(best subject, best score, lead over the next) of each of a text's units; None if it has no unit with a word."""
    units, paragraph = [], []
    for k, block in enumerate(units_of(text or "")):
        for u in block:
            grams = hasher(u)
            if grams:
                units.append(grams)
                paragraph.append(k)
    if not units:
        return None
    _, compact = np.unique(paragraph, return_inverse=True)
    raw = _scores(weights, bias, *_flat(units))
    near = raw + PARAGRAPH * _paragraph_means(raw, compact)
    best = (near + DOCUMENT * raw.mean(0)).argmax(1)
    two = np.sort(np.partition(near, -2, axis=1)[:, -2:], axis=1) if near.shape[1] > 1 else np.column_stack((near - MARGIN, near))
    return best, two[:, 1], two[:, 1] - two[:, 0]


def shares_of(scores: tuple[np.ndarray, np.ndarray, np.ndarray] | None, thresholds: np.ndarray) -> np.ndarray | None:
    """Share of each subject among the units that tell one (others, like shelf marks, do not count); None if there are no units."""
    if scores is None:
        return None
    best, top, lead = scores
    sure = (top > thresholds[best]) & (lead >= MARGIN)
    told = int(sure.sum())
    if told < max(1, LEAST * len(best)):
        return np.zeros(len(thresholds))
    return np.bincount(best[sure], minlength=len(thresholds)) / told


def document_shares(text: str | None, hasher: Hasher, weights: np.ndarray, bias: np.ndarray, thresholds: np.ndarray, junk: bool = False) -> np.ndarray | None:
    """Share of each subject among a text's units that tell one; None if it has no unit with a word or is junk."""
    return None if junk else shares_of(unit_scores(text, hasher, weights, bias), thresholds)


def train(rows: list[tuple[str, list[int], bool]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, bias, thresholds) from (text, subject numbers, labelled by people) rows."""
    hasher = Hasher()
    units, target, allowed = [], [], []
    held = [r for i, r in enumerate(r for r in rows if r[2]) if i % 2]
    kept = [r for r in rows if not r[2]] + [r for i, r in enumerate(r for r in rows if r[2]) if not i % 2]
    for text, subjects, _ in kept:
        if len(units) >= UNITS:
            break
        mark = np.zeros(n, dtype=np.float32)
        mark[subjects] = 1.0 / len(subjects)
        for block in units_of(text):
            for u in block:
                if grams := hasher(u):
                    units.append(grams)
                    target.append(mark)
                    allowed.append(mark > 0)
    if not units:
        return np.zeros((BUCKETS, n), dtype=np.float32), np.full(n, -9.0, dtype=np.float32), np.zeros(n)
    flat, sizes = _flat(units)
    target, allowed = np.array(target), np.array(allowed)
    weights, bias = _fit(flat, sizes, target, n)
    scores = _scores(weights, bias, flat, sizes)
    best = scores.argmax(1)
    clear = scores[np.arange(len(best)), best] > -1.0
    second = np.zeros_like(target)
    second[np.arange(len(best))[clear], best[clear]] = 1.0
    agreed = allowed[np.arange(len(best)), best] | clear & (scores.max(1) > 1.0)
    keep = np.flatnonzero(agreed & clear)
    chosen = [units[i] for i in keep]
    if chosen:
        weights, bias = _fit(*_flat(chosen), second[keep], n)
    return weights, bias, calibrate(held, hasher, weights, bias, n)


def calibrate(held: list[tuple[str, list[int], bool]], hasher: Hasher, weights: np.ndarray, bias: np.ndarray, n: int) -> np.ndarray:
    """Per subject the score threshold with the best F1 against people's labels of held-out documents; 0 where there are none."""
    grid = np.array([-1.5, -1.0, -0.5, 0.0, 0.5, 1.0])
    found = np.zeros((len(grid), len(held), n), dtype=bool)
    truth = np.zeros((len(held), n), dtype=bool)
    junk = unreadable([r[0] for r in held])
    for d, (text, subjects, _) in enumerate(held):
        truth[d, subjects] = True
        scores = None if junk[d] else unit_scores(text, hasher, weights, bias)
        for g, t in enumerate(grid):
            shares = shares_of(scores, np.full(n, t))
            if shares is not None:
                found[g, d] = shares >= SHARE
    hits = (found & truth).sum(1)
    f1 = 2 * hits / np.maximum(1, found.sum(1) + truth.sum(0))
    middle = np.abs(grid)[:, None] * 1e-3  # among equals the middle of the grid
    return np.where(truth.any(0), grid[(f1 - middle).argmax(0)], 0.0)


def training_rows(requests: DataFrame, documents: DataFrame, labels: DataFrame, subjects: list[str], sample: int = SAMPLE, labelled: int = LABELLED) -> DataFrame:
    """(text, subjects ARRAY<INT>, by_people) of at most ``sample`` requests and ``labelled`` documents, chosen by hash.

    The share of rows that can be enough is drawn by hash before texts are moved, so the one task that orders
    the sample reads about twice the sample, whatever the size of the tables.
    """

    def drawn(df: DataFrame, key: str, enough: int) -> DataFrame:
        share = min(1.0, 2.0 * enough / max(1, df.count()))
        return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))

    requests = requests if "collection" in requests.columns else requests.withColumn("collection", F.lit(None).cast("string"))
    number = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(i))])
    once = latest(drawn(requests, "request_id", sample), "request_id", "received_at", "title", "body", "url", "canonical_url", "tags", "collection")
    segments = F.split(F.lower(F.coalesce("canonical_url", "url", F.lit(""))), "[/?#&=.]+")
    named = F.concat(segments, F.array(F.lower(F.trim(F.coalesce("collection", F.lit(""))))), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))))
    marked = F.array_distinct(F.filter(F.transform(named, lambda x: F.try_element_at(number, x)), lambda x: x.isNotNull()))
    weak = once.where("body is not null").select(F.concat_ws("\n\n", "title", "body").alias("text"), marked.alias("subjects"), F.xxhash64("request_id").alias("h_")).where(F.size("subjects") > 0)
    told = drawn(labels, "doc_id", labelled).select("doc_id", F.try_element_at(number, F.lower(F.trim("subject"))).alias("s_"), "labeller").where("s_ is not null and doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("s_")).alias("subjects"))
    people = documents.select("doc_id", "text").where("text is not null").join(told, "doc_id").select("text", "subjects", F.xxhash64("doc_id").alias("h_"))
    a = weak.orderBy("h_").limit(sample).select("text", "subjects", F.lit(False).alias("by_people"))
    return a.unionByName(people.orderBy("h_").limit(labelled).select("text", "subjects", F.lit(True).alias("by_people")))


def fit(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trains in one task on the bounded sample; returns (weights, bias, thresholds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(t, s, p) for b in batches for t, s, p in zip(*(b.column(k).to_pylist() for k in range(3)))]
        data.sort(key=lambda r: (r[2], r[0]))
        np.random.default_rng(3).shuffle(data)
        w, b, t = train(data, n)
        parts = [w.astype(np.float32).tobytes(), b.astype(np.float32).tobytes(), t.astype(np.float64).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int32()), pa.array(parts, pa.binary())], ["part", "data"])

    got = {r["part"]: bytes(r["data"]) for r in rows.coalesce(1).mapInArrow(run, "part int, data binary").collect()}  # of fixed size
    if not got:
        return np.zeros((BUCKETS, n), dtype=np.float32), np.full(n, -9.0, dtype=np.float32), np.zeros(n)
    return np.frombuffer(got[0], np.float32).reshape(BUCKETS, n), np.frombuffer(got[1], np.float32), np.frombuffer(got[2], np.float64)


def subject_shares(documents: DataFrame, requests: DataFrame, labels: DataFrame, areas: DataFrame, sample: int = SAMPLE, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, subject, share) of every document and subject with a share above 0.

    share: part of the document's sentences or entries (of those that tell any subject) that are about this one. Null, empty and
    unreadable texts give no rows; neither do empty tables or a table of subjects without training rows. Repeated rows
    give repeated rows. ``areas`` is the list of subjects; it is collected (12 rows).
    """
    spark = documents.sparkSession
    subjects = sorted({r[0] for r in areas.select(F.lower(F.trim("subject"))).where("subject is not null").distinct().limit(1000).collect()})
    if not subjects:
        return documents.where("false").select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("share"))
    rows = save_table(training_rows(requests, documents, labels, subjects, sample, labelled), "training")
    model = spark.sparkContext.broadcast(fit(rows, len(subjects)))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, thresholds = model.value
        hasher = Hasher()
        for batch in batches:
            at, names, shares = [], [], []
            texts = batch.column(1).to_pylist()
            for i, (text, junk) in enumerate(zip(texts, unreadable(texts))):
                got = document_shares(text, hasher, weights, bias, thresholds, junk)
                if got is not None:
                    for k in np.flatnonzero(got):
                        at.append(i)
                        names.append(subjects[k])
                        shares.append(float(got[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "subject", "share"])

    src = fan_out(documents.select("doc_id", "text"))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, subject string, share double")


def document_subjects(documents: DataFrame, requests: DataFrame, labels: DataFrame, areas: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject): subjects that make up at least ``share`` of a document's sentences or entries."""
    return subject_shares(documents, requests, labels, areas).where(F.col("share") >= share - 1e-9).select("doc_id", "subject")
