"""Problem 5: text statistics per document and what its text is: prose, list, table or junk.

Method: a batch of documents is one column of lines; length, symbol, punctuation, bullet and common-word statistics are computed for all lines at once (Arrow's string kernels),
summed to blocks (lines between blank lines) and documents, and fixed-threshold rules are applied to all blocks at once, each failure with a
recorded reason. No document and no line is looked at by itself in Python.

Two sets of rules: the published ones for web corpora apply to whole documents (``published_failures``: Rae et al. 2021, "Scaling Language Models", table A1, and Raffel et al. 2020, the lines of C4,
with their thresholds); the rules that tell what a block is (``failed_rules``) are this engine's own, as no published rule tells lists from tables from junk.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.plans.runtime import fan_out

# Common function words, English and Swedish.
COMMON = frozenset(
    "the of and to a in is that it for on as with was by at be this from are or an one not have has had but they we "
    "you his her its their which who what when where why how all any each every both such than then there these those "
    "i he she them our your my no if so only after before because between until while until without nor neither "
    "och att det som en ett är på för av med den till i har de när om inte från hur vem var kan man ska skulle hade "
    "sedan mellan utan både enligt eller men vi du jag han hon sin sitt dem där här blir bara mer än efter före under".split()
)
# Stop words of the published rules, and their Swedish counterparts.
STOP_WORDS = frozenset("the be to of and that have with och att det som är på med har".split())
#: Characters that are white space, and the classes built on them: white, visible, letters (other numbers, as in fractions, count as such).
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
_S, _V, _L = f"[{_BLANKS}]", f"[^{_BLANKS}]", r"[\p{L}\p{Nl}\p{No}]"
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
_BULLET = r"^(?:[-*+•·‣◦▪●○■□–—»>]|\[[ xX]?\]|[☐☑☒✓✔✗]|\(?\p{Nd}{1,4}[.)]|\(?[A-Za-z][.)]|\(?[ivxIVX]{1,5}[.)])[ \t\x{a0}]+" + _V
_LEADER = rf"(?:\.{{3,}}|…+|(?:[ \x{{a0}}]\.){{3,}}){_S}*\p{{Nd}}{{1,5}}$"
_MARK = rf"^(?:<!--.*-->$|#{{1,6}}{_S}|(?:[-=*_]{_S}*){{3,}}$)"
_RULE = rf"^[|+\-=:{_BLANKS}]+$"
_PAIR = rf"^[^:{_BLANKS}][^:]{{0,38}}:{_S}+{_V}"
_STOP = r"[.!?…:;][\"'”’»)\]]*$"
_TERMINAL = r"[.!?\"”]$"
_SPACED = r" (?:[/\;~&·•¦:–—=>-]|::|=>|->|//) "
_HEX = rf"^(?:[0-9a-fA-F]{{4,16}}[:{_BLANKS}]{_S}*)?(?:[0-9a-fA-F]{{2,4}}(?:{_S}+|$)){{5,}}"
_BASE64 = rf"^{_V}{{28,}}$"
_MARKUP = r"</?[A-Za-z!][^<>]*>|\{[^{}\n]*\}|//[0-9a-f]{6,}|&#?[\p{L}\p{N}_]+;"
_MOJIBAKE = "ÃÂâðŸ¤¶¼½±©®œ€�ï¿"
#: Fixed thresholds of the block rules.
MIN_LETTERS, MAX_REPLACEMENT, MAX_MOJIBAKE, MAX_MARKUP, MIN_COMMON, MAX_TOP_WORD, MIN_DISTINCT = 0.5, 0.02, 0.15, 0.5, 0.06, 0.34, 0.2
FORMS = ("prose", "list", "table", "junk")


#: Classes of a code point, as bits; KNOWN marks those that were looked up.
WHITE, LETTER, DIGIT, GARBLED, LOST, WIDE, KNOWN = (1 << k for k in range(7))
_CLASSES = np.zeros(0x110000, dtype=np.uint8)


def _class_of(code: int) -> int:
    c = chr(code)
    kind = unicodedata.category(c)
    tests = ((WHITE, c in _BLANKS), (LETTER, kind[0] == "L" or kind in ("Nl", "No")), (DIGIT, kind == "Nd"), (GARBLED, c in _MOJIBAKE), (LOST, c == "�"), (WIDE, code > 127))
    return KNOWN | sum(bit for bit, yes in tests if yes)


class Characters:
    """The code points of all lines as one array of class bits, counted by line."""

    def __init__(self, lines: pa.Array):
        size = _length(lines)
        self.starts = np.concatenate(([0], np.cumsum(size)))
        ends = np.frombuffer(lines.buffers()[1], dtype=np.int32)[lines.offset : lines.offset + len(lines) + 1] if len(lines) else np.zeros(1, dtype=np.int32)
        data = memoryview(lines.buffers()[2])[ends[0] : ends[-1]] if lines.buffers()[2] is not None else b""
        codes = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), dtype=np.uint32)
        bits = _CLASSES[codes]
        if new := set(codes[bits == 0].tolist()):
            for code in new:
                _CLASSES[code] = _class_of(code)
            bits = _CLASSES[codes]
        self.bits = bits

    def _by_line(self, marks: np.ndarray) -> np.ndarray:
        summed = np.zeros(len(marks) + 1, dtype=np.int32)
        np.cumsum(marks, out=summed[1:])
        return (summed[self.starts[1:]] - summed[self.starts[:-1]]).astype(np.int64)

    def counts(self) -> dict[str, np.ndarray]:
        """Per line: visible characters, letters, digits, those of each other class, and runs of visible characters."""
        there = self.bits & WHITE == 0
        begins = there.copy()
        begins[1:] &= ~there[:-1]
        first = self.starts[:-1][np.diff(self.starts) > 0]
        begins[first] = there[first]
        wide = self._by_line(self.bits & WIDE != 0)
        rare = {n: self._by_line(self.bits & bit != 0) if wide.any() else wide for n, bit in (("garbled", GARBLED), ("lost", LOST))}
        return {"visible": self._by_line(there), "letters": self._by_line(self.bits & LETTER != 0), "digits": self._by_line(self.bits & DIGIT != 0), "tokens": self._by_line(begins), "wide": wide, **rare}


def _count(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(lines, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _has(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False).astype(bool)


def _with(lines: pa.Array, text: str) -> np.ndarray:
    return pc.match_substring(lines, text).to_numpy(zero_copy_only=False).astype(bool)


def _length(lines: pa.Array) -> np.ndarray:
    return pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)


def _without(lines: pa.Array, pattern: str, by: str = "") -> pa.Array:
    return pc.replace_substring_regex(lines, pattern, by)


def _words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(line, code) of every word in order, and the distinct words: letters with inner apostrophes and hyphens, or digits, in lower case."""
    text = _without(pc.utf8_lower(lines), r"(\p{Nd}+)", r" \1 ")
    text = _without(text, r"[^\p{L}\p{Nl}\p{No}\p{Nd}'’\-]+|['’\-]{2,}", " ")
    text = _without(text, r"['’\-]+(?: |$)|(?:^| )['’\-]+", " ")
    parts = pc.split_pattern(text, " ")
    line = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    flat = pc.dictionary_encode(parts.flatten())
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    code, names = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
    there = (_length(names) > 0)[code] if len(names) else np.zeros(0, dtype=bool)
    return line[there], code[there], names


def _cells(bare: pa.Array) -> np.ndarray:
    """Number of cells of each line in the layout it most likely has; 1 if it has none."""
    bars = pc.count_substring(pc.utf8_trim(bare, "|"), "|").to_numpy(zero_copy_only=False)
    tabs, gaps = _count(bare, "\t"), _count(bare, "[ \xa0]{2,}")
    separated = np.zeros(len(bare), dtype=np.int64)
    some = np.flatnonzero(_has(bare, "[,;]"))
    if len(some):
        part = bare.take(pa.array(some))
        # every run of plain characters becomes two, so that a match may end in one and the next begin in the other
        commas = _count(_without(part, f"[^,;{_BLANKS}]+", "xx"), "x,x") + _count(part, ",") - _count(part, ",+")
        separated[some] = commas + _count(part, ";") - _count(part, f";{_S}") - pc.ends_with(part, ";").to_numpy(zero_copy_only=False)
    other = np.maximum(separated, _count(bare, _SPACED))
    return 1 + np.select([_with(bare, "|"), tabs > 0, gaps > 0], [bars, tabs, gaps], other)


def _repeated(unit: np.ndarray, code: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Whether the words of each of ``n`` units are few and repeated. unit, code: of every word; sizes: lengths of the distinct words."""
    words, chars = np.bincount(unit, minlength=n), np.bincount(unit, weights=sizes[code] if len(code) else None, minlength=n)
    pairs, times = np.unique(unit * max(1, len(sizes)) + code, return_counts=True)
    owner, word = pairs // max(1, len(sizes)), pairs % max(1, len(sizes))
    top = np.zeros(n)
    np.maximum.at(top, owner, times * sizes[word] if len(word) else times)
    distinct = np.bincount(owner, minlength=n)
    return (words >= 10) & ((top > MAX_TOP_WORD * chars) | (distinct < np.minimum(MIN_DISTINCT * words, 20)))


def _judge(lines: pa.Array, bare: pa.Array, chars: dict[str, np.ndarray], block: np.ndarray, word_block: np.ndarray, word_code: np.ndarray, names: pa.Array, common_name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form, reason, visible characters) of each block; ``block`` gives the block of each of its lines, in order."""
    n = int(block[-1]) + 1 if len(block) else 0

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(block, weights=x, minlength=n)

    size = total(np.ones(len(block)))
    shown, tokens = chars["visible"], chars["tokens"]
    visible = total(shown)
    words = np.bincount(word_block, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        common = np.where(words > 0, np.bincount(word_block, weights=common_name[word_code] if len(word_code) else None, minlength=n) / np.maximum(words, 1), 0.0)
    plain = total(_length(lines) != pc.binary_length(lines).to_numpy(zero_copy_only=False)) == 0
    bar, tab = _with(lines, "|"), _with(bare, "\t")
    bullets, stop = total(_has(pc.utf8_ltrim(lines, _BLANKS), _BULLET)), _has(bare, _STOP)
    stops = total(stop)
    leaders = total(_has(pc.utf8_slice_codeunits(bare, -120), _LEADER))
    letters = total(chars["letters"])
    alnum = letters + total(chars["digits"])
    rule = _has(bare, _RULE)
    repeated = _repeated(word_block, word_code, _length(names), n)
    starts = np.searchsorted(block, np.arange(n + 1))
    tagged = np.flatnonzero(total(_with(lines, "<") | _with(lines, "{")) > 0)
    markup = np.zeros(n)
    if len(tagged):
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), lines).take(pa.array(tagged)), "\n")
        markup[tagged] = _length(whole) - _length(_without(whole, _MARKUP))
    pairs = (size >= 2) & (stops <= 0.25 * size) & (total(_has(bare, _PAIR) & (tokens <= 8)) >= 0.7 * size)
    with_cells = total(np.where(rule, 0, _cells(bare) >= 2))
    table_like = (with_cells >= 0.75 * np.maximum(total(~rule), 1)) & ((total(bar | tab) >= 0.6 * size) | (common < 0.2))
    flowing = (common >= 0.2) & (2 * bullets < size) & plain & (total(bar | _with(lines, "\t") | _with(lines, "...")) == 0) & (words < 40 * size)
    rules = (
        (flowing & repeated, "junk", "repeated_words"), (flowing, "prose", "ok"),
        (total(chars["lost"]) > MAX_REPLACEMENT * visible, "junk", "replacement_chars"),
        ((visible >= 12) & ~plain & (total(chars["garbled"]) > MAX_MOJIBAKE * visible), "junk", "mojibake"),
        (total(_has(bare, _HEX)) > 0.6 * size, "junk", "hex_dump"),
        ((common < MIN_COMMON) & (total(_has(bare, _BASE64)) > 0.6 * size), "junk", "encoded"),
        (markup > MAX_MARKUP * visible, "junk", "markup"),
        ((2 * (bullets + leaders) >= size) & (letters >= 0.2 * visible) & ((size > 1) | (common < 0.3)) & (leaders > bullets), "list", "leader_lines"),
        ((2 * (bullets + leaders) >= size) & (letters >= 0.2 * visible) & ((size > 1) | (common < 0.3)), "list", "bullet_lines"),
        ((size >= 2) & (stops < 0.4 * size) & (alnum >= 0.4 * total(np.where(rule, 0, shown))) & ~pairs & table_like, "table", "cell_rows"),
        ((letters < MIN_LETTERS * visible) & (alnum < 0.6 * visible), "junk", "few_letters"),
        (pairs, "list", "key_value_lines"),
        ((size >= 4) & (stops <= 0.25 * size) & (common < 0.2) & (total((tokens <= 6) & ~stop) >= 0.8 * size), "list", "short_lines"),
        (repeated, "junk", "repeated_words"),
        ((words >= 3) & (visible > 28 * words), "junk", "long_words"),
        ((words >= 12) & (common < MIN_COMMON), "junk", "no_common_words"),
        ((words == 0) & (visible >= 12), "junk", "no_words"),
    )
    tests = [r[0] for r in rules]
    form = np.select(tests, [FORMS.index(r[1]) for r in rules], FORMS.index("prose"))
    reason = np.select(tests, list(range(len(rules))), 1)
    return form, np.array([r[2] for r in rules], dtype=object)[reason] if n else np.empty(0, dtype=object), visible


def batch_stats(texts: pa.Array) -> dict[str, np.ndarray | list]:
    """All statistics and the form of each text, by column; null is treated as empty, its form is ``blank``."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    split = pc.split_pattern_regex(texts, _LINE_END)
    split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    doc = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    every = split.flatten()
    bare = pc.utf8_trim(every, _BLANKS)
    seen = np.flatnonzero(_length(bare) > 0)
    at = pa.array(seen)
    # a blank line lies between two shown ones if their numbers are not consecutive
    gap = np.diff(seen, prepend=-2) > 1
    doc, lines, bare = doc[seen], every.take(at), bare.take(at)

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=n)

    fence = pc.starts_with(bare, "```").to_numpy(zero_copy_only=False).astype(bool)
    before = np.cumsum(fence) - fence
    first = np.searchsorted(doc, np.arange(n))
    fenced = ~fence & ((before - before[np.minimum(first, max(0, len(before) - 1))][doc] if len(doc) else before) % 2 == 1)
    mark = _has(bare, _MARK) & (_length(bare) < 120) & _has(bare, r"[\p{L}\p{N}]")
    body = ~fence & ~fenced & ~mark
    opens = body & (gap | np.concatenate(([True], ~body[:-1])) | (np.diff(doc, prepend=-1) != 0))
    block = (np.cumsum(opens) - 1)[body]
    word_line, word_code, names = _words(pa.array(np.where(fence, "", bare.to_numpy(zero_copy_only=False)), pa.string()) if fence.any() else bare)
    common_name = pc.is_in(names, pa.array(sorted(COMMON))).to_numpy(zero_copy_only=False) if len(names) else np.zeros(0)
    block_of = np.full(len(doc), -1)
    block_of[body] = block
    inside = block_of[word_line] >= 0
    keep = pa.array(np.flatnonzero(body))
    chars = Characters(bare).counts()
    form, reason, visible = _judge(lines.take(keep), bare.take(keep), {k: v[body] for k, v in chars.items()}, block, block_of[word_line][inside], word_code[inside], names, common_name)
    owner = doc[body][np.flatnonzero(opens[body])]
    shares = np.stack([np.bincount(owner, weights=visible * (form == k), minlength=n) for k in range(len(FORMS))], axis=1) if n else np.zeros((0, 4))
    whole = total(chars["visible"])
    words = np.bincount(doc[word_line], minlength=n)
    word_chars = np.bincount(doc[word_line], weights=_length(names)[word_code] if len(word_code) else None, minlength=n)
    letters, digits = total(chars["letters"]), total(chars["digits"])
    length, count = _length(texts), total(np.ones(len(doc)))
    bullets, stops = total(_has(bare, _BULLET)), total(_has(bare, _STOP))
    common = np.bincount(doc[word_line], weights=common_name[word_code] if len(word_code) else None, minlength=n)

    def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(b > 0, a / np.maximum(b, 1), 0.0)

    unread = shares[:, 1:]
    worst = np.array(FORMS[1:], dtype=object)[unread.argmax(1)] if n else np.empty(0, dtype=object)
    stop_name = pc.is_in(names, pa.array(sorted(STOP_WORDS))).to_numpy(zero_copy_only=False) if len(names) else np.zeros(0, dtype=bool)
    alphabetic = _has(names, _L) if len(names) else np.zeros(0, dtype=bool)
    stop_pairs = np.unique(doc[word_line] * max(1, len(names)) + word_code if len(word_code) else np.zeros(0, dtype=np.int64))
    stop_pairs = stop_pairs[stop_name[stop_pairs % max(1, len(names))]] if len(stop_pairs) else stop_pairs
    stats = {
        "char_count": length, "word_count": words, "mean_word_length": part(word_chars, words), "alpha_ratio": part(letters, whole),
        "replacement_char_ratio": part(_count(texts, "�"), length), "symbol_ratio": np.where(whole > 0, 1 - part(letters + digits, whole), 0.0), "line_count": count.astype(np.int64),
        "punctuated_line_ratio": part(stops, count), "bullet_line_ratio": part(bullets, count), "common_word_ratio": part(common, words),
        **{f"{f}_ratio": part(shares[:, k], whole) for k, f in enumerate(FORMS)},
        "doc_form": np.where(whole == 0, "blank", np.where(2 * unread.sum(1) > whole, worst, "prose")),
        "failed_rules": _by_weight(owner, reason, np.where(form == 0, 0, visible), n),
    }
    signs = total(_count(bare, r"#|\.\.\.|…"))
    stats["published_failures"] = _published(
        words, stats["mean_word_length"], part(signs, words), stats["bullet_line_ratio"], part(total(_has(bare, r"(?:\.\.\.|…)$")), count),
        part(np.bincount(doc[word_line], weights=alphabetic[word_code] if len(word_code) else None, minlength=n), words), np.bincount(stop_pairs // max(1, len(names)), minlength=n), part(total(_has(bare, _TERMINAL)), count),
    )
    return stats


def _by_weight(owner: np.ndarray, reason: np.ndarray, weight: np.ndarray, n: int) -> list[list[str]]:
    """Per document the reasons that have a weight, greatest sum first, then in the order in which they came up."""
    out: list[dict[str, float]] = [{} for _ in range(n)]
    for k in np.flatnonzero(weight):  # blocks that are no prose
        mine = out[owner[k]]
        mine[reason[k]] = mine.get(reason[k], 0.0) + float(weight[k])
    return [sorted(d, key=d.get, reverse=True) for d in out]


def _published(words, mean_length, signs, bullets, ellipses, alphabetic, stop_words, terminal) -> list[list[str]]:
    """Per document the published rules it fails, by name, with their published thresholds."""
    rules = (
        ("under_50_words", words < 50), ("over_100000_words", words > 100_000), ("mean_word_length_not_3_to_10", (mean_length < 3) | (mean_length > 10)),
        ("symbol_to_word_ratio_over_0.1", signs > 0.1), ("bullet_lines_over_0.9", bullets > 0.9), ("ellipsis_lines_over_0.3", ellipses > 0.3),
        ("alphabetic_words_under_0.8", alphabetic < 0.8), ("under_2_stop_words", stop_words < 2), ("no_line_with_terminal_punctuation", terminal == 0),
    )
    failed = np.stack([r for _, r in rules], axis=1)
    return [[rules[k][0] for k in np.flatnonzero(row)] for row in failed]


_STATS = (
    ("char_count", pa.int64(), "bigint"), ("word_count", pa.int64(), "bigint"), ("mean_word_length", pa.float64(), "double"),
    ("alpha_ratio", pa.float64(), "double"), ("replacement_char_ratio", pa.float64(), "double"), ("symbol_ratio", pa.float64(), "double"),
    ("line_count", pa.int64(), "bigint"), ("punctuated_line_ratio", pa.float64(), "double"), ("bullet_line_ratio", pa.float64(), "double"),
    ("common_word_ratio", pa.float64(), "double"), ("prose_ratio", pa.float64(), "double"), ("list_ratio", pa.float64(), "double"),
    ("table_ratio", pa.float64(), "double"), ("junk_ratio", pa.float64(), "double"), ("doc_form", pa.string(), "string"),
    ("failed_rules", pa.list_(pa.string()), "array<string>"), ("published_failures", pa.list_(pa.string()), "array<string>"),
)


def text_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics, doc_form, failed_rules, published_failures) of every row.

    doc_form is prose, list, table, junk, or blank (null, empty and blank texts, with zero
    statistics). failed_rules names the rules by which parts are no prose, most characters first; published_failures the published rules that the whole text fails. Repeated rows
    stay repeated; other columns are not read; an empty table gives an empty table. Narrow.
    """
    src = fan_out(df.select(df[id_col].alias("id_"), df[text_col].cast("string").alias("text_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                stats = batch_stats(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(stats[name], kind) for name, kind, _ in _STATS)], ["id_", *(x[0] for x in _STATS)])

    kind = dict(src.dtypes)["id_"]
    return src.mapInArrow(run, f"id_ {kind}, " + ", ".join(f"{a} {c}" for a, _, c in _STATS)).withColumnRenamed("id_", id_col)


def not_prose(df: DataFrame) -> DataFrame:
    """(doc_id, doc_form) of documents of which more than half of the visible characters are list, table or junk."""
    return text_quality(df).where(F.col("doc_form").isin("list", "table", "junk")).select("doc_id", "doc_form")
