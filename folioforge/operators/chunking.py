"""Markdown to chunks: parts, units with page, section and chapter, greedy packing, long-text splitting.

A source is one row with its whole Markdown, so nothing is shuffled: each task reads its rows through one Arrow function. Within a source the work goes by
columns, not by steps: parts are spans of the text, what holds at a part is the last mention before it (a running maximum over positions), and the
packer jumps from chunk to chunk by binary search on prefix sums of unit lengths. Lengths are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import PAGE_MARKER, slugify
from folioforge.operators.pages import one_or_mixed
from folioforge.plans.config import Chunking
from folioforge.plans.runtime import fan_out

# Patterns of blank lines, page markers, headings and chapter titles.
_BLANK = re.compile(r"\n\s*\n")
_MARKER = re.compile(PAGE_MARKER)
_PAGE_HEADING = re.compile(r"^\s*##\s+Page\s+\d+\s*$", re.M | re.I)
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.M)
_LONE_H1 = re.compile(r"^\s*#\s+(.+?)\s*$")
_CHAPTER = re.compile(r"^(?:chapter\s+\d+\b.*|\d+\s*:\s+\S.*)$", re.I)
_COVERS = re.compile(r"\bthis\s+chapter\s+covers\b", re.I)
_DECORATION = re.compile(r"[`*_]+")
#: How many parts after a heading may say that it opens a chapter.
AHEAD = 4


class Units(NamedTuple):
    """Columns of a source's units, in order: text, and what holds at its end."""

    text: list[str]
    page: list[int | None]
    section: list[str | None]
    chapter: list[str | None]


def _plain(heading: str) -> str:
    """A heading without tags and decoration, its white space single."""
    return " ".join(_DECORATION.sub("", re.sub(r"<[^>]+>", "", heading)).split())


def _last_mention(values: list) -> list:
    """Each place with the last value that is not None, up to and with it."""
    at = np.array([-1 if v is None else k for k, v in enumerate(values)], dtype=np.int64)
    return [None if k < 0 else values[k] for k in np.maximum.accumulate(at)] if len(at) else []


def _opens_chapter(lone: np.ndarray, covers: np.ndarray) -> np.ndarray:
    """Per part whether one of the next AHEAD parts names what the chapter covers before another lone heading of level 1 comes."""
    n = len(lone)
    far = n + AHEAD + 1
    after = np.arange(1, n + 1)

    def following(marks: np.ndarray) -> np.ndarray:
        places = np.append(np.flatnonzero(marks), far)
        return places[np.searchsorted(places, after)]

    cover = following(covers)
    return (cover < following(lone)) & (cover < after + AHEAD)


def units_of(markdown: str, strict_page_boundaries: bool = False) -> Units:
    """Units of a Markdown text in order.

    Parts with only page markers and page headings are glued to the part after them. By default a
    paragraph joined to the next page's marker by a single line feed counts to that next page, as pages are combined with one
    line feed; strict_page_boundaries keeps it on its own page.
    """
    if strict_page_boundaries:
        markdown = re.sub(r"(?<!\n)\n(?=<!--\s*page:)", "\n\n", markdown)
    parts = [p for p in _BLANK.split(markdown) if p.strip()]
    if not parts:
        return Units([], [], [], [])
    markers = [_MARKER.search(p) for p in parts]
    headings = [_HEADING.search(p) if "#" in p else None for p in parts]
    titles = [None if h is None else _plain(h[2]) for h in headings]
    top = np.array([h is not None and len(h[1]) == 1 for h in headings])
    explicit = top & np.array([t is not None and bool(_CHAPTER.match(t)) for t in titles])
    untitled = np.zeros(len(parts), dtype=bool)
    if (top & ~explicit).any():
        lone = np.array([bool(_LONE_H1.search(p)) for p in parts])
        covers = np.array(["overs" in p.lower() and bool(_COVERS.search(_plain(p))) for p in parts])
        # a part that is a lone heading cannot also say what is covered before itself: the heading comes first
        untitled = top & ~explicit & _opens_chapter(lone, covers & ~lone)
    number = np.cumsum(untitled)
    pages = _last_mention([None if m is None else int(m[1]) for m in markers])
    sections = _last_mention([h[2].strip() if h is not None and t and not t.lower().startswith("page ") else None for h, t in zip(headings, titles)])
    chapters = _last_mention([t if e else f"Chapter {k}: {t}" if u else None for t, e, u, k in zip(titles, explicit, untitled, number)])
    bare = [m is not None and not _PAGE_HEADING.sub("", _MARKER.sub("", p)).strip() or m is None and h is not None and not _PAGE_HEADING.sub("", p).strip() for p, m, h in zip(parts, markers, headings)]
    ends = [k for k, b in enumerate(bare) if not b]
    if not ends or ends[-1] != len(parts) - 1:
        ends.append(len(parts) - 1)
    texts = []
    for first, last in zip([0, *(k + 1 for k in ends)], ends):
        texts.append("\n".join([parts[first], *(p.rstrip() for p in parts[first + 1 : last + 1])]).strip())
    return Units(texts, [pages[k] for k in ends], [sections[k] for k in ends], [chapters[k] for k in ends])


def split_long(text: str, target: int = 1200, overlap: int = 150) -> list[tuple[int, int]]:
    """(from, to) of windows of at most ``target``, ended after the last blank or line feed if that lies past the middle."""
    if len(text) <= target:
        return [(0, len(text))]
    places = [m.start() for m in re.finditer("[ \n]", text)]
    reach, out, begin, end = max(200, target // 2), [], 0, 0
    while end < len(text):
        end = min(begin + target, len(text))
        if end < len(text):
            last = places[k - 1] if (k := bisect_left(places, end)) else -1
            end = last + 1 if last > begin + reach else end
        out.append((begin, end))
        begin = max(end - overlap, begin + 1)
    return out


class Packed(NamedTuple):
    text: str
    pages: list[int]
    section: str | None
    chapter: str | None


def pack(markdown: str, sizes: Chunking) -> list[Packed]:
    """Chunks of one source in order.

    Units between two bounds (a new chapter, or a unit longer than the target, which is split by itself) are packed: the chunk that
    begins with unit i ends before the first unit that would take it past the target once it holds the minimum. Both conditions grow with the units, so
    each is one binary search. A chunk cut for its length hands its last characters and last page on to the next one.
    """
    u = units_of(markdown, sizes.strict_page_boundaries)
    lengths = [len(t) for t in u.text]
    total = [0, *accumulate(x + 2 for x in lengths)]
    n, out = len(lengths), []
    long_ = [x > sizes.target for x in lengths]
    opens = [k > 0 and bool(c) and c != u.chapter[k - 1] for k, c in enumerate(u.chapter)]
    bounds = [k for k in range(n) if long_[k] or opens[k] or k and long_[k - 1]]
    for start, stop in zip([0, *bounds], [*bounds, n]):
        if start == stop:
            continue
        if long_[start]:
            text, own = u.text[start], [u.page[start]] if u.page[start] else []
            out += [Packed(text[a:b].strip(), own, u.section[start], u.chapter[start]) for a, b in split_long(text, sizes.target, sizes.overlap)]
            continue
        tail, kept, i = "", [], start
        while i < stop:
            room = total[i] + 2 - (len(tail) + 2 if tail else 0)
            j = max(bisect_right(total, sizes.target + room) - 1, bisect_left(total, sizes.minimum + room), i + 1)
            cut = j < stop
            j = min(j, stop)
            text = "\n\n".join([tail, *u.text[i:j]] if tail else u.text[i:j])
            pages = kept + [p for p in u.page[i:j] if p]
            newest = j if cut or j < n and long_[j] and not opens[j] else j - 1
            out.append(Packed(text, pages, u.section[newest], u.chapter[j - 1]))
            tail = text[-sizes.overlap :].strip() if cut and sizes.overlap else ""
            kept = pages[-1:] if tail else []
            i = j
    return [c for c in out if c.text.strip()]


def chunk_sources(sources: DataFrame, id_col: str, text_col: str, sizes: Chunking | None = None) -> DataFrame:
    """(source, chunk_index, inferred_chapter, section, pages ARRAY<INT>, text) of every source with a text; pages are distinct and in order."""
    s = sizes or Chunking()
    src = fan_out(sources.select(F.col(id_col).cast("string").alias("source"), F.col(text_col).alias("text")).where("text is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(sid, i, c.chapter, c.section, sorted(set(c.pages)), c.text.strip()) for sid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, c in enumerate(pack(text, s))]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["source", "chunk_index", "inferred_chapter", "section", "pages", "text"])

    return src.mapInArrow(run, "source string, chunk_index int, inferred_chapter string, section string, pages array<int>, text string")


def chapter_texts(sources: DataFrame, chapters: DataFrame) -> DataFrame:
    """(source_id, text): what is chunked of each source: the text of its named chapter if that was stored, else its whole document.

    sources: (source_id, chapter, document); chapters: (source_id, chapter, text), at most one row each. An empty chapter name is none.
    """
    own = chapters.select("source_id", F.col("chapter").alias("chapter_"), F.col("text").alias("own_"))
    joined = sources.withColumn("chapter_", F.nullif("chapter", F.lit(""))).join(own, ["source_id", "chapter_"], "left")
    return joined.select("source_id", F.coalesce("own_", "document").alias("text"))


def split_documents(documents: DataFrame, id_col: str, text_col: str, target: int = 1200, overlap: int = 150) -> DataFrame:
    """(id, piece, char_from, char_to, text) of each text's windows; blank windows are left out, pieces are stripped."""
    src = fan_out(documents.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).where("text is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(split_long(text, target, overlap)):
                    at.append(i)
                    rows.append((k, a, b, text[a:b].strip()))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id_", "piece", "char_from", "char_to", "text"])

    kind = dict(src.dtypes)["id_"]
    return src.mapInArrow(run, f"id_ {kind}, piece int, char_from int, char_to int, text string").where("text != ''").withColumnRenamed("id_", id_col)


def describe_chunks(packed: DataFrame, manifests: DataFrame, pages: DataFrame, version: str = "v2") -> DataFrame:
    """Chunks with id, page range, extraction method, OCR model and their source's metadata.

    packed: output of chunk_sources; manifests: one row per source; pages: one row per page. Methods are looked up by a
    join of the exploded pages and aggregated per chunk; a source without a manifest is left out.
    """
    spread = packed.select("source", "chunk_index", F.explode("pages").alias("page_number")).distinct()
    meta = pages.select(F.col("source_id").alias("source"), "page_number", "extraction_method", "ocr_model")
    read = spread.join(meta, ["source", "page_number"], "left").groupBy("source", "chunk_index").agg(
        one_or_mixed(F.coalesce("extraction_method", F.lit("unknown"))).alias("extraction_method"), one_or_mixed(F.nullif("ocr_model", F.lit(""))).alias("ocr_model")
    )
    joined = packed.join(read, ["source", "chunk_index"], "left").join(manifests.withColumnRenamed("chapter", "given_").withColumnRenamed("source_id", "source"), "source")
    chapter = F.coalesce(F.nullif("given_", F.lit("")), "inferred_chapter")
    first = F.array_min("pages")
    label = slugify(F.coalesce(F.concat(F.lit("ch"), chapter), F.lit("doc")))
    cid = F.format_string("%s_%s_p%04d_%04d", F.col("source"), label, F.coalesce(first, F.lit(0)), F.col("chunk_index"))
    keep = [c for c in manifests.columns if c not in ("source_id", "chapter", "text")]
    return joined.select(
        cid.alias("chunk_id"), F.col("source").alias("source_id"), chapter.alias("chapter"), "section", first.alias("page_start"), F.array_max("pages").alias("page_end"),
        "chunk_index", "text", F.coalesce("extraction_method", F.lit("mixed")).alias("extraction_method"), "ocr_model", F.lit(version).alias("chunker_version"), *keep,
    )
