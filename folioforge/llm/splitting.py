"""Problem 4: oversized texts cut at natural boundaries with overlap.

Method: a text's boundaries of each strength (paragraph, line, sentence, word) are sorted offset
arrays, made from one pass over its tokens (runs without white space) and their offset prefix
sums. A piece's end is the last boundary under the limit, by binary search; the next piece
begins ``overlap`` characters before it; where no boundary lies in reach, a hard cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.retrieval import live_matching
from folioforge.plans.runtime import fan_out

LIMIT = 1200
OVERLAP = 150
LEVELS = ("paragraph", "line", "sentence", "word")
_RUN = re.compile(r"\S+")
_LINE_END = re.compile(r"\r\n|\r|\n")
_STOP = re.compile(r"[.!?][\"'”’»)\]}]?$")
_MARKER = re.compile(r"<!--\s*page:\s*(\d+)\s*-->")
_HEADING = re.compile(r"^#{1,6}[ \t]+(.+?)[ \t]*$", re.M)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, strength): the tokens' offsets and, of the gap before each token, the coarsest boundary (index in LEVELS).

    Gap i lies between token i - 1 and token i; its strength is 0 if it holds a blank line outside
    fenced blocks, 1 if a line end, 2 if the token before it ends a sentence, else 3.
    """
    spans = [m.span() for m in _RUN.finditer(text)]
    starts = np.array([a for a, _ in spans], dtype=np.int64)
    ends = np.array([b for _, b in spans], dtype=np.int64)
    strength = np.full(len(spans), 3, dtype=np.int8)
    fenced = False
    for i, (a, b) in enumerate(spans):
        at_line_start = i == 0
        if i:
            gap = text[spans[i - 1][1] : a]
            breaks = len(_LINE_END.findall(gap)) if "\n" in gap or "\r" in gap else 0
            if breaks:
                at_line_start = True
                strength[i] = 0 if breaks > 1 and not fenced else 1
            elif _STOP.search(text, max(spans[i - 1][0], spans[i - 1][1] - 2), spans[i - 1][1]):
                strength[i] = 2
        if at_line_start and text.startswith("```", a):
            fenced = not fenced
    return starts, ends, strength


def coarsest_sufficient(text: str, limit: int = LIMIT, overlap: int = OVERLAP, marks=None) -> str:
    """The coarsest of LEVELS such that cutting at all its places and all coarser ones leaves no stretch over limit - overlap; else ``hard``."""
    starts, ends, strength = marks if marks is not None else boundaries(text)
    most = limit - overlap
    if not len(starts):
        return "paragraph"
    for level, name in enumerate(LEVELS):
        first = np.flatnonzero(strength <= level)
        first = first if len(first) and first[0] == 0 else np.concatenate(([0], first))
        last = np.concatenate((first[1:] - 1, [len(starts) - 1]))
        if int((ends[last] - starts[first]).max()) <= most:
            return name
    return "hard"


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, marks=None) -> list[tuple[int, int, str]]:
    """(from, to, boundary) of the pieces of a text; one piece if it is within the limit.

    Pieces cover the text; each but the first begins exactly ``overlap`` characters before the end of
    the one before it, so consecutive pieces share them. No piece exceeds ``limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    if len(text) <= limit:
        return [(0, len(text), "whole")]
    starts, ends, strength = marks if marks is not None else boundaries(text)
    need = coarsest_sufficient(text, limit, overlap, (starts, ends, strength))
    allowed = len(LEVELS) - 1 if need == "hard" else LEVELS.index(need)
    places = starts[1:][strength[1:] <= allowed].tolist()
    names = strength[1:][strength[1:] <= allowed].tolist()
    words = starts[1:].tolist()
    pieces, begin = [], 0
    while len(text) - begin > limit:
        edge = begin + limit
        k = bisect_right(places, edge) - 1
        w = bisect_right(words, edge) - 1
        if k >= 0 and places[k] > begin + overlap:
            end, kind = places[k], LEVELS[names[k]]
        elif w >= 0 and words[w] > begin + overlap:
            end, kind = words[w], "word"
        else:
            end, kind = edge, "hard"
        pieces.append((begin, end, kind))
        begin = end - overlap
    pieces.append((begin, len(text), "end"))
    return pieces


_PIECES = "chunk_id string, piece int, section string, page int, char_from int, char_to int, boundary string, text string"


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, piece, section, page, char_from, char_to, boundary, text) of each chunk longer than ``limit``.

    section: the last Markdown heading before or at the piece's start, else the chunk's; page: the last
    page marker there, else page_start. A chunk counts once, by its latest row (one whose latest text is short or null gives none, whatever came before); null texts, texts
    within the limit and empty tables give no rows. Lengths are code points. A text without any white space is cut hard.
    """
    src = fan_out(live_matching(chunks, F.length("text") > limit, "text", "section", "page_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cid, text, section, page in zip(*(batch.column(k).to_pylist() for k in range(4))):
                pages = [(m.start(), int(m[1])) for m in _MARKER.finditer(text)]
                heads = [(m.start(), m[1]) for m in _HEADING.finditer(text)]
                for i, (a, b, kind) in enumerate(cut(text, limit, overlap)):
                    p = bisect_right(pages, (a, float("inf"))) - 1
                    h = bisect_right(heads, (a, "\U0010ffff")) - 1
                    rows.append((cid, i, heads[h][1] if h >= 0 else section, pages[p][1] if p >= 0 else page, a, b, kind, text[a:b]))
            cols = list(zip(*rows)) or [[]] * 8
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _PIECES.split(", ")])

    return src.select("chunk_id", "text", "section", "page_start").mapInArrow(run, _PIECES)


def sufficient_boundaries(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, boundary) of each chunk longer than ``limit``: the coarsest boundary that suffices."""
    src = fan_out(live_matching(chunks, F.length("text") > limit, "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [coarsest_sufficient(t, limit, overlap) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], ["chunk_id", "boundary"])

    return src.select("chunk_id", "text").mapInArrow(run, "chunk_id string, boundary string")
