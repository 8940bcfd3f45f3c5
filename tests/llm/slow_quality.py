"""The quality rules read text by text and line by line: slow, and written apart from the columnar operator that is held against them."""

from __future__ import annotations

import re
from collections import Counter

from folioforge.llm.quality import COMMON

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+")
_BULLET = re.compile(r"(?:[-*+•·‣◦▪●○■□–—»>]|\[[ xX]?\]|[☐☑☒✓✔✗]|\(?\d{1,4}[.)]|\(?[A-Za-z][.)]|\(?[ivxIVX]{1,5}[.)])[ \t\xa0]+\S")
_LEADER = re.compile(r"(?:\.{3,}|…{1,}|(?:[ \xa0]\.){3,})\s*\d{1,5}$")
_MARK = re.compile(r"<!--.*-->$|#{1,6}\s|(?:[-=*_]\s*){3,}$")
_GAP = re.compile(r"\S(?:[ \xa0]{2,}|[ \xa0]*\t[ \xa0]*)(?=\S)")
_RULE = re.compile(r"[|+\-=:\s]+$")
_PAIR = re.compile(r"[^\s:][^:]{0,38}:\s+\S")
_STOP = re.compile(r"[.!?…:;][\"'”’»)\]]*$")
_CSV = re.compile(r"(?<=[^\s,;]),(?=[^\s,;])|;(?=[^\s])|(?<=,),")
_SPACED = re.compile(r" (?:[/\\;~&·•¦:–—=>-]|::|=>|->|//) | / +(?=/)")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_HEX = re.compile(r"(?:[0-9a-fA-F]{4,16}[:\s]\s*)?(?:[0-9a-fA-F]{2,4}\s+){5,}")
_BASE64 = re.compile(r"\S{28,}$")
_MARKUP = re.compile(r"</?[A-Za-z!][^<>]*>|\{[^{}\n]*\}|//[0-9a-f]{6,}|&#?\w+;")
_MOJIBAKE = re.compile(r"[ÃÂâðŸ¤¶¼½±©®œ€�ï¿]")
#: Fixed thresholds of the rules.
MIN_LETTERS, MAX_REPLACEMENT, MAX_MOJIBAKE, MAX_MARKUP, MIN_COMMON, MAX_TOP_WORD, MIN_DISTINCT = 0.5, 0.02, 0.15, 0.5, 0.06, 0.34, 0.2


def _visible(text: str) -> int:
    return sum(map(len, text.split()))


def _cells(line: str) -> int:
    """Number of cells of a line in the layout it most likely has; 1 if it has none."""
    bare = line.strip()
    if "|" in bare:
        return bare.strip("|").count("|") + 1
    if "\t" in bare:
        return bare.count("\t") + 1
    gaps = len(_GAP.findall(bare))
    return gaps + 1 if gaps else max(len(_CSV.findall(bare)), len(_SPACED.findall(bare))) + 1


def _table_like(lines: list[str], common: float) -> bool:
    cells = [_cells(x) for x in lines if not _RULE.match(x.strip())] or [1]
    if sum(c >= 2 for c in cells) < 0.75 * len(cells):
        return False
    piped = sum("|" in x or "\t" in x.strip() for x in lines)
    return piped >= 0.6 * len(lines) or common < 0.2


def classify_block(lines: list[str], words: list[str], common: float) -> tuple[str, str]:
    """(form, reason) of a block of visible lines: prose, list, table or junk. words: its words in lower case; common: their share of function words."""
    text, n = "\n".join(lines), len(lines)
    bullets = sum(bool(_BULLET.match(x.lstrip())) for x in lines)
    if common >= 0.2 and 2 * bullets < n and text.isascii() and "|" not in text and "\t" not in text and "..." not in text and len(words) < 40 * n:
        return _repeated(text, words) or ("prose", "ok")
    visible = _visible(text)
    if text.count("�") > MAX_REPLACEMENT * visible:
        return "junk", "replacement_chars"
    if visible >= 12 and not text.isascii() and len(_MOJIBAKE.findall(text)) > MAX_MOJIBAKE * visible:
        return "junk", "mojibake"
    if sum(bool(_HEX.match(x.strip() + " ")) for x in lines) > 0.6 * n:
        return "junk", "hex_dump"
    if common < MIN_COMMON and sum(bool(_BASE64.match(x.strip())) and " " not in x.strip() for x in lines) > 0.6 * n:
        return "junk", "encoded"
    if ("<" in text or "{" in text) and sum(map(len, _MARKUP.findall(text))) > MAX_MARKUP * visible:
        return "junk", "markup"
    letters = sum(map(len, _LETTERS.findall(text)))
    alnum = letters + sum(map(len, _DIGITS.findall(text)))
    leaders = sum(bool(_LEADER.search(x.rstrip()[-120:])) for x in lines)
    if 2 * (bullets + leaders) >= n and letters >= 0.2 * visible and (n > 1 or common < 0.3):
        return "list", "leader_lines" if leaders > bullets else "bullet_lines"
    stops = sum(bool(_STOP.search(x.rstrip())) for x in lines)
    pairs = n >= 2 and stops <= 0.25 * n and sum(bool(_PAIR.match(x.strip())) and len(x.split()) <= 8 for x in lines) >= 0.7 * n
    if n >= 2 and stops < 0.4 * n and alnum >= 0.4 * _visible(" ".join(x for x in lines if not _RULE.match(x.strip()))) and not pairs and _table_like(lines, common):
        return "table", "cell_rows"
    if letters < MIN_LETTERS * visible and alnum < 0.6 * visible:
        return "junk", "few_letters"
    if pairs:
        return "list", "key_value_lines"
    if n >= 4 and stops <= 0.25 * n and common < 0.2 and sum(len(x.split()) <= 6 and not _STOP.search(x.rstrip()) for x in lines) >= 0.8 * n:
        return "list", "short_lines"
    if rule := _repeated(text, words):
        return rule
    if len(words) >= 3 and visible > 28 * len(words):
        return "junk", "long_words"
    if len(words) >= 12 and common < MIN_COMMON:
        return "junk", "no_common_words"
    if not words and visible >= 12:
        return "junk", "no_words"
    return "prose", "ok"


def _repeated(text: str, words: list[str]) -> tuple[str, str] | None:
    if len(words) < 10:
        return None
    counts = Counter(words)
    if max(n * len(w) for w, n in counts.items()) > MAX_TOP_WORD * sum(map(len, words)) or len(counts) < min(MIN_DISTINCT * len(words), 20):
        return "junk", "repeated_words"
    return None


def document_stats(text: str | None) -> dict:
    """All statistics and the form of one text; null is treated as empty, its form is ``blank``."""
    text = text or ""
    shares = {"prose": 0, "list": 0, "table": 0, "junk": 0, "other": 0}
    reasons: Counter = Counter()
    block: list[str] = []
    fenced = False
    shown = bullet_lines = stop_lines = n_words = n_common = word_chars = 0

    def count(part: str) -> tuple[list[str], int]:
        nonlocal n_words, n_common, word_chars
        words = _WORD.findall(part.lower())
        common = sum(map(COMMON.__contains__, words))
        n_words, n_common, word_chars = n_words + len(words), n_common + common, word_chars + sum(map(len, words))
        return words, common

    def close() -> None:
        if block:
            part = "\n".join(block)
            words, common = count(part)
            form, why = classify_block(block, words, common / len(words) if words else 0.0)
            seen = _visible(part)
            shares[form] += seen
            if form != "prose":
                reasons[why] += seen
            block.clear()

    for line in text.splitlines():
        bare = line.strip()
        if not bare:
            close()
            continue
        shown += 1
        bullet_lines += bool(_BULLET.match(bare))
        stop_lines += bool(_STOP.search(bare))
        if bare.startswith("```"):
            close()
            fenced = not fenced
            shares["other"] += _visible(bare)
        elif fenced or (bare[0] in "<#-=*_" and len(bare) < 120 and _MARK.match(bare) and any(map(str.isalnum, bare))):
            close()
            count(bare)
            shares["other"] += _visible(bare)
        else:
            block.append(line)
    close()
    n, visible = len(text), sum(shares.values())
    unread = shares["list"] + shares["table"] + shares["junk"]
    form = "blank" if not visible else max(("list", "table", "junk"), key=shares.get) if 2 * unread > visible else "prose"
    letters = sum(map(len, _LETTERS.findall(text)))
    alnum = letters + sum(map(len, _DIGITS.findall(text)))
    part = {f"{k}_ratio": shares[k] / visible if visible else 0.0 for k in ("prose", "list", "table", "junk")}
    return {
        "char_count": n, "word_count": n_words, "mean_word_length": word_chars / n_words if n_words else 0.0,
        "alpha_ratio": letters / visible if visible else 0.0, "replacement_char_ratio": text.count("�") / n if n else 0.0,
        "symbol_ratio": 1 - alnum / visible if visible else 0.0, "line_count": shown,
        "punctuated_line_ratio": stop_lines / shown if shown else 0.0, "bullet_line_ratio": bullet_lines / shown if shown else 0.0,
        "common_word_ratio": n_common / n_words if n_words else 0.0, **part,
        "doc_form": form, "failed_rules": [r for r, _ in reasons.most_common()],
    }
