"""Problems 4 to 10: brute force, round trips, held-out labels and edge cases."""

from __future__ import annotations

import itertools
import random
import re
import sys
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import ocr_repair, packing, quality, site_lines, splitting, subjects, tokens

sys.path.insert(0, str(Path(__file__).resolve().parent))
import slow_quality  # noqa: E402

T0 = datetime(2025, 1, 1)


# Problem 4

CHUNKS = "chunk_id string, created_at timestamp, text string, section string, page_start int, piece string, boundary string"


def chunks(spark, rows):
    return spark.createDataFrame([(i, T0, t, "S", 3, "clash", "clash") for i, t in rows], CHUNKS)


def slow_boundary(text, limit, overlap):
    """Cuts with regular expressions, level by level."""
    lines, fenced, paragraphs = text.split("\n"), False, [[]]
    for line in lines:
        if line.startswith("```"):
            fenced = not fenced
        if not line.strip() and not fenced:
            paragraphs.append([])
        else:
            paragraphs[-1].append(line)
    stretches = ["\n".join(p) for p in paragraphs]
    for name, pattern in (("paragraph", None), ("line", r"\n"), ("sentence", r"(?<=[.!?])\s+|(?<=[.!?][\"')\]])\s+"), ("word", r"\s+")):
        if pattern:
            stretches = [p for s in stretches for p in re.split(pattern, s)]
        if all(len(s.strip()) <= limit - overlap for s in stretches):
            return name
    return "hard"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["aaaa", "bb.", "cc!\"", "dddddddddddddddd", "\n", "\n\n", "\n```\n", " ", "e?)", "```"]), min_size=5, max_size=60).map(" ".join), st.integers(20, 60))
def test_boundary_equals_slow_reading(text, limit):
    text = re.sub(r" *\n *", "\n", text)
    assert splitting.coarsest_sufficient(text, limit, 5) == slow_boundary(text, limit, 5)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n", min_size=0, max_size=900), st.integers(20, 200), st.integers(0, 15))
def test_pieces(text, limit, overlap):
    pieces = splitting.cut(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in pieces)
    assert all(q[0] == p[1] - overlap and q[1] > p[1] for p, q in zip(pieces, pieces[1:]))
    assert text[: pieces[0][1]] + "".join(text[a + overlap : b] for a, b, _ in pieces[1:]) == text


def test_split_tables(spark):
    rows = [("a", "# Head\n\n" + "Some words here. " * 100), ("b", None), ("c", ""), ("d", "x" * 1200), ("e", "x" * 1201), ("f", "word " * 200_000), (None, "y" * 2000)]
    df = chunks(spark, rows + rows[:1])
    assert {(r.chunk_id, r.boundary) for r in splitting.sufficient_boundaries(df).collect()} == {("a", "sentence"), ("e", "hard"), ("f", "word")}
    pieces = splitting.split_chunks(df).collect()
    assert Counter(r.chunk_id for r in pieces)["e"] == 2 and all(len(r.text) <= 1200 for r in pieces)
    assert {(r.section, r.page) for r in pieces if r.chunk_id == "a"} == {("Head", 3)}
    assert splitting.sufficient_boundaries(chunks(spark, [])).count() == 0 and splitting.split_chunks(chunks(spark, [])).count() == 0


def test_a_shortened_chunk_is_no_case(spark):
    late = T0 + timedelta(1)
    rows = [("a", T0, "word " * 300, "S", 1, "", ""), ("a", late, "short", "S", 1, "", ""), ("b", T0, "short", "S", 1, "", ""), ("b", late, "word " * 300, "S", 1, "", ""), ("c", None, "x" * 1300, "S", 1, "", ""), ("d", T0, "y" * 1300, "S", 1, "", ""), ("d", late, None, "S", 1, "", "")]
    df = spark.createDataFrame(rows, CHUNKS)
    assert {tuple(r) for r in splitting.sufficient_boundaries(df).collect()} == {("b", "word"), ("c", "hard")}
    assert {r.chunk_id for r in splitting.split_chunks(df).collect()} == {"b", "c"}


# Problem 5

DOCS = "doc_id bigint, text string, id_ string, text_ string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)


def form_of(text):
    return quality.batch_stats(pa.array([text], pa.string()))["doc_form"][0]


PROSE = "The reader saw that the plan was good, and it was done before the rain.\nNobody asked why the others had not come with them."


@pytest.mark.parametrize(
    ("text", "form"),
    [
        (PROSE, "prose"), ("A: " + PROSE.replace("\n", "\nB: "), "prose"), ("- red lamp\n- blue lamp\n- lamp", "list"), ("1. a lamp\n2. a cup\n3. a pan", "list"),
        ("[ ] wash\n[x] dry\n[ ] fold", "list"), ("Lamp: red thing\nCup: blue thing\nPan: old thing\nJar: new thing", "list"), ("Lamps and cups ....... 3\nPans ....... 9\nJars ...... 12", "list"),
        ("| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |", "table"), ("name\tsize\nlamp\t3\ncup\t4", "table"), ("name,size,place\nlamp,3,x\ncup,4,y", "table"), ("item          size\nlamp          3\nold cup       4", "table"),
        ("item / place\nlamp / Rome\ncup / Oslo\npan / Bonn", "table"), ("word " * 60, "junk"), ("@@##$$ %%^^&&\n!!!! ???? ####", "junk"), ("Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4\n" * 5, "junk"),
        ("00000000  27 ee 99 6c 7a 93 72 fb\n00000010  d5 90 c4 1b 81 67 63 3a", "junk"), ("hdfj xttj ddkn wwrl pjpq lgwc fpgj fwvk lldk hcff lphm bwzj ppjz", "junk"), ("no� rs�a i�m d�b " * 9, "junk"),
        ("", "blank"), (" \n\t", "blank"), (None, "blank"),
    ],
)
def test_forms(text, form):
    assert form_of(text) == form


_LINES = st.sampled_from([
    "the plan was good, and it was done before the rain.", "- a red lamp", "2) cup", "| a | b |", "|---|", "x\ty", "a,b,,c;d", "name  size  place", "Lamp: red", "", " \t", "```", "# Head", "<!-- page: 3 -->", "***",
    "Pans ....... 9", "27 ee 99 6c 7a 93", "Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4", "<b>x</b>", "{a: 1}", "Ã¥Ã¤Â¶", "no� rs�a", "word word word word word", "it's a-b--c 'q' x1y2 ½ Ⅷ", "@@ ## $$", "och det är bra…", "a / b / c", "[x] done",
])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(_LINES, st.text(st.sampled_from("aB1 .,;|-:'\t /é\xa0\x1c\x85�✓"), max_size=25)), max_size=12), st.sampled_from(["\n", "\r\n", "\u2028"]))
def test_columns_equal_slow_reading(lines, end):
    text = end.join(lines)
    got, want = quality.batch_stats(pa.array([None, text, text + end, ""], pa.string())), slow_quality.document_stats(text)
    for name, value in want.items():
        assert got[name][1] == (pytest.approx(value) if isinstance(value, float) else value), name
    assert list(got["doc_form"][[0, 3]]) == ["blank"] * 2


def test_documents_equal_slow_reading(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: slow_quality.document_stats(r.text) for r in rows}
    for r in quality.text_quality(spark.read.parquet(f"{data}/documents.parquet")).collect():
        assert all(r[k] == (pytest.approx(v) if isinstance(v, float) else v) for k, v in want[r.doc_id].items())


def test_published_rules():
    good = " ".join([PROSE.replace("\n", " ")] * 3)
    got = quality.batch_stats(pa.array([good, "- a\n- b\n" * 30, "# " * 60 + "the and lamp...", "lamp " * 10], pa.string()))["published_failures"]
    assert got[0] == [] and "bullet_lines_over_0.9" in got[1] and "mean_word_length_not_3_to_10" in got[1] and "symbol_to_word_ratio_over_0.1" in got[2]
    assert got[3] == ["under_50_words", "under_2_stop_words", "no_line_with_terminal_punctuation"]


def test_half_decides():
    items = "\n".join(f"- item number {i}" for i in range(12))
    assert form_of(PROSE + "\n\n" + items) == "list"
    assert form_of("\n\n".join([PROSE] * 3) + "\n\n" + items) == "prose"


def test_quality_tables(spark):
    rows = [(1, PROSE), (2, None), (3, "- a b\n- c d"), (3, "- a b\n- c d"), (4, "word " * 300_000), (None, "x")]
    got = quality.text_quality(docs(spark, rows)).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].word_count == 25 and by[1].doc_form == "prose" and by[1].failed_rules == []
    assert by[2].char_count == 0 and by[4].failed_rules == ["repeated_words"]
    assert [tuple(r) for r in quality.not_prose(docs(spark, rows)).orderBy("doc_id").collect()] == [(3, "list"), (3, "list"), (4, "junk")]
    assert quality.text_quality(docs(spark, [])).count() == 0


# Problem 6

REQ = "request_id string, received_at timestamp, body string, publisher string, origin string, site string, line_id string"
PUB = "publisher string, origin string, home_zone string, date_order string"


def requests(spark, rows):
    return spark.createDataFrame([(i, T0, b, p, o, "clash", "clash") for i, b, p, o in rows], REQ)


def slow_lines(rows, pubs):
    site = {p.strip().lower(): o for p, o in pubs}
    once = {i: (b, site.get(p.strip().lower()) if p else o) for i, b, p, o in rows}

    def norm(line):
        return re.sub(r"\d+", "0", re.sub(r"[\W_]+", " ", line.lower()).strip())

    total, seen = Counter(s for _, s in once.values()), defaultdict(set)
    for i, (b, s) in once.items():
        for line in (b or "").split("\n"):
            seen[s, norm(line)].add(i)
    return {(i, k + 1) for i, (b, s) in once.items() if s for k, line in enumerate((b or "").split("\n")) if re.search(r"[^\W\d_]", norm(line)) and len(seen[s, norm(line)]) >= max(5, 0.03 * total[s])}


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    pubs = [("One", "site1"), ("Two", "site2")]
    furniture = ["Share: this, {}!", "© {} House", "By A Writer", "12345", ""]
    rows = []
    for n in range(300):
        body = "\n".join(rng.choice([f"text {rng.randrange(10**9)} words", rng.choice(furniture).format(rng.randrange(99))]) for _ in range(6))
        rows.append((f"r{n}", body, rng.choice(["One", " one", "TWO", None]), rng.choice(["site1", "site3", None])))
    rows.append(("nul", None, "One", None))
    df, pub = requests(spark, rows + rows[:20]), spark.createDataFrame([(*p, "UTC", "dmy") for p in pubs], PUB)
    got = {tuple(r) for r in site_lines.repeated_lines(df, pub).collect()}
    assert got == slow_lines(rows, pubs) and len(got) > 200
    clean = {r.request_id: r for r in site_lines.clean_bodies(df, pub).collect()}
    assert len(clean) == 301 and clean["nul"].body is None
    assert sum(r.n_removed for r in clean.values()) == len(got)
    assert site_lines.repeated_lines(df.where("false"), pub).count() == 0


def test_sequences_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"r{n}", "\n".join(rng.sample(["alpha line", "beta line", "gamma line", "delta line"], rng.randrange(1, 5))), None, "s") for n in range(60)]
    got = {(r.pattern, r.n_lines): r.support for r in site_lines.site_patterns(requests(spark, rows), spark.createDataFrame([], PUB)).collect()}
    count: dict[int, Counter] = defaultdict(Counter)
    for _, b, _, _ in rows:
        ls = b.split("\n")
        for k in range(1, 5):
            count[k].update(set(itertools.combinations(ls, k)))
    want = Counter(v for k in count for v in count[k].values() if v >= 5 and k)
    assert Counter(got.values()) == want


def test_sequences_of_any_length(spark):
    """Longer than four lines, repeated lines, with rare and frequent lines between."""
    rng = random.Random(6)
    names = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    rows = [(f"r{n:02d}", "\n".join(w for name in names for w in ([name] * (rng.random() < 0.8) + [f"only{'x' * n}y{name}"] * (rng.random() < 0.3) + ["beta"] * (rng.random() < 0.1))), None, "s") for n in range(40)]
    empty = spark.createDataFrame([], PUB)
    got = [(r.n_lines, r.support) for r in site_lines.site_patterns(requests(spark, rows), empty).collect()]
    count: Counter = Counter()
    for _, b, _, _ in rows:
        ls = [x for x in b.split("\n") if x in names]
        count.update({tuple(ls[i] for i in at) for k in range(1, len(ls) + 1) for at in itertools.combinations(range(len(ls)), k)})
    want = [(len(p), n) for p, n in count.items() if n >= 5]
    assert sorted(got) == sorted(want) and max(k for k, _ in got) > 4
    removed = [sorted(tuple(r) for r in site_lines.repeated_lines(requests(spark, rows), empty, levels=n).collect()) for n in (1, 2, 4, None)]
    assert removed[0] and all(r == removed[0] for r in removed)


# Problem 7


def vocabulary(words):
    return {w: (True, None, 50) for w in words.split()}


def test_lines_of_a_scanned_page():
    text = "The fragr-\nant stew of the so-\n12  A Fine B00k\ncalled cook was g0od\n- 12 -\nand tbe end"
    words = vocabulary("the fragrant stew of so-called cook was good and end") | {"g0od": (False, [("good", 50)], 1), "tbe": (False, [("the", 50)], 3)}
    cases, repaired = ocr_repair.read_lines(text, "A Fine Book", None, 12, 12, words)
    assert cases == [(1, "hyphen"), (3, "header"), (4, "misread"), (5, "page_number"), (6, "misread")]
    assert repaired == "The fragrant stew of the so-called cook was good and the end"


def test_skeletons():
    for seen, meant in (("aiithor", "author"), ("clraft", "draft"), ("tbe", "the"), ("lcdger", "ledger"), ("5ince", "since"), ("k9", "kg"), ("savv", "saw"), ("fernton", "femton"), ("hnk", "link"), ("f6r", "för"), ("hyresga¨sten", "hyresgästen"), ("coliimnar", "columnar")):
        assert ocr_repair.skeleton(seen) == ocr_repair.skeleton(meant)
    assert ocr_repair.skeleton("court") != ocr_repair.skeleton("orchard")


PAGES = "source_id string, page_number int, extraction_method string, extracted_at timestamp, ocr string, word string"
SCANNED = "chunk_id string, created_at timestamp, source_id string, title string, chapter string, page_start int, page_end int, text string, ocr string, word string, n string"


def test_misreadings_are_learnt(spark):
    rng = random.Random(1)
    plain = "the engineer checks each bridge and the author writes about a quiet river before the harvest".split()
    rows = [(f"c{i}", T0, "clean", "T", None, 1, 1, " ".join(rng.sample(plain, 12)), None, None, None) for i in range(60)]
    noisy = {"the": "tbe", "author": "aiithor", "river": "r1ver"}
    want = set()
    for i in range(40):
        lines = [rng.sample(plain, 8) for _ in range(3)]
        for n, words in enumerate(lines):
            for k, w in enumerate(words):
                if w in noisy and rng.random() < 0.15:
                    words[k] = noisy[w]
                    want.add((f"o{i}", n + 1, "misread"))
        rows.append((f"o{i}", T0, "scan", "T", None, 1, 1, "\n".join(map(" ".join, lines)), None, None, None))
    rows += [("n", T0, "scan", None, None, None, None, None, None, None, None), (None, T0, "scan", None, None, 1, 1, "tbe", None, None, None)]
    pages = spark.createDataFrame([("scan", 1, "failed", T0, "", ""), ("scan", 1, "ocr", T0 + timedelta(1), "", ""), ("clean", 1, "ocr", T0, "", ""), ("clean", 1, "markdown", T0 + timedelta(1), "", ""), (None, None, None, None, "", "")], PAGES)
    df = spark.createDataFrame(rows + rows[:3], SCANNED)
    assert {tuple(r) for r in ocr_repair.noise_lines(df, pages).collect()} == want
    assert not any(w in r.text.split() for r in ocr_repair.repaired_texts(df, pages).collect() for w in noisy.values())
    assert ocr_repair.noise_lines(df.where("false"), pages).count() == 0 and ocr_repair.noise_lines(df, pages.where("false")).count() == 0


def test_skip_gram_tells_contexts_apart():
    """Words of two groups that share neighbours within their group only: vectors fit their own group's neighbours better."""
    rng = np.random.default_rng(0)
    counts = np.zeros((40, 20), dtype=np.int64)
    for w in range(40):
        counts[w, rng.integers(0, 10, 60) + 10 * (w % 2)] += 3
    v, u = ocr_repair.skip_gram(counts)
    fit = v @ u.T
    own = np.array([fit[w, 10 * (w % 2) : 10 * (w % 2) + 10].mean() for w in range(40)])
    other = np.array([fit[w, 10 * (1 - w % 2) : 10 * (1 - w % 2) + 10].mean() for w in range(40)])
    assert (own > other + 1).all()
    again = ocr_repair.skip_gram(counts)
    assert (again[0] == v).all() and (again[1] == u).all()


def test_a_misread_word_is_corrected_by_its_neighbours(spark):
    """``c0w`` stands for cow or eow, which look alike: what stands around decides, occurrence by occurrence."""
    rng = random.Random(4)
    farm, ship = "the farmer milks a brown {} in the barn today", "the sailor ties a long {} to the mast today"
    rows = [(f"c{i}", T0, "clean", "T", None, 1, 1, (farm.format("cow") if i % 2 else ship.format("eow")), None, None, None) for i in range(200)]
    rows += [(f"o{i}", T0, "scan", "T", None, 1, 1, (farm if i % 2 else ship).format("c0w"), None, None, None) for i in range(20)]
    rng.shuffle(rows)
    pages = spark.createDataFrame([("scan", 1, "ocr", T0, "", ""), ("clean", 1, "markdown", T0, "", "")], PAGES)
    got = {r.chunk_id: r.text for r in ocr_repair.repaired_texts(spark.createDataFrame(rows, SCANNED), pages).collect()}
    assert len(got) == 20 and all((farm.format("cow") if int(i[1:]) % 2 else ship.format("eow")) == t for i, t in got.items())


def farm_and_ship(rng, extra):
    """Clean texts of cows and eows, scanned ones of ``c0w``, and clean ones of ``extra`` words more frequent than these; (rows, pages, what is right)."""
    farm, ship = "farmer milks brown {} behind barn", "sailor ties long {} around mast"
    rows = [(f"c{i}", T0, "clean", "T", None, 1, 1, (farm.format("cow") if i % 2 else ship.format("eow")), None, None, None) for i in range(100)]
    rows += [(f"o{i}", T0, "scan", "T", None, 1, 1, (farm if i % 2 else ship).format("c0w"), None, None, None) for i in range(20)]
    words = [f"{a}{b}{c}n" for a in "bdgkt" for b in "aeou" for c in "bdfgjklmnprstvxz"]
    words = [w + x for w in words for x in "aeo"][:extra]
    rows += [(f"f{i}", T0, "clean", "T", None, 1, 1, " ".join(rng.sample(words, len(words))), None, None, None) for i in range(150)]
    pages = [("scan", 1, "ocr", T0, "", ""), ("clean", 1, "markdown", T0, "", "")]
    return rows, pages, {f"o{i}": (farm.format("cow") if i % 2 else ship.format("eow")) for i in range(20)}


def test_neighbours_tell_however_many_words_are_more_frequent(spark):
    """700 words are more frequent than all that tell cow from eow."""
    rows, pages, want = farm_and_ship(random.Random(5), 700)
    got = ocr_repair.repaired_texts(spark.createDataFrame(rows, SCANNED), spark.createDataFrame(pages, PAGES)).collect()
    assert {r.chunk_id: r.text for r in got} == want


@pytest.mark.parametrize("core", (ocr_repair.CORE, 20))
def test_words_of_shared_places_have_their_own_vectors(spark, monkeypatch, core):
    """None of the words told apart, nor of those that tell, is among the words trained together; with a small core their entries come by a join."""
    for name, value in (("TRAINED", 30), ("SHARED", 4), ("CORE", core)):
        monkeypatch.setattr(ocr_repair, name, value)
    rows, pages, want = farm_and_ship(random.Random(5), 40)
    got = ocr_repair.repaired_texts(spark.createDataFrame(rows, SCANNED), spark.createDataFrame(pages, PAGES)).collect()
    assert {r.chunk_id: r.text for r in got} == want


def test_neighbour_counts_hold_every_pair(spark, monkeypatch):
    monkeypatch.setattr(ocr_repair, "CELLS", 8)
    rng = random.Random(8)
    top, tail = ["the", "and", "of"], [f"word{c}" for c in "abcdefgh"]
    texts = [" ".join(rng.choices([*top, *tail, "-", "Worda,"], k=30)) for _ in range(40)]
    want, number = Counter(), {w: k for k, w in enumerate(top)}
    for t in texts:
        ws = [ocr_repair.clean_word(x) for x in t.split()]
        for i, j in ((i, j) for i in range(30) for j in (i + 1, i + 2) if j < 30 and "-" not in (ws[i], ws[j])):
            a, b = (ocr_repair.place(ws[x], number, 2) for x in (i, j))
            want[None, min(a, b) * 5 + max(a, b)] += 1
            want.update((ws[x], p) for x, p in ((i, b), (j, a)) if ws[x] in tail)
    got = ocr_repair.neighbour_counts(spark.createDataFrame([(t,) for t in texts], "text string"), top, 2).collect()
    assert {(r.word, r.cell): r.n for r in got} == want and len(got) == len(want)


# Problem 8


@pytest.fixture(scope="module")
def whole():
    import base64
    from pathlib import Path

    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(tokens.VOCABULARIES, "byte_bpe_50k.tiktoken").open("rb"))}
    return tiktoken.Encoding("whole", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n\r  　'sà1a.é\x1c\x85​<|>"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_fragments_encode_like_the_whole(whole, text):
    assert tokens.encoder().encode(text) == whole.encode_ordinary(text)
    assert b"".join(tokens.encoder().fragments(text)).decode() == text


def test_cuts_lie_within_words_too():
    """Byte pairs that no token holds are cut wherever they stand; never after white space."""
    parts = tokens.encoder().fragments("the qzxq's word  end")
    assert any(p.isalpha() and p[:1] not in b"t " for p in parts) and not any(p.endswith(b" ") for p in parts[:-1])
    assert tokens.encoder().certain.sum() > 20_000


def test_encode_tables(spark, whole):
    rows = [(1, "Hello  world, it's <|endoftext|>"), (2, None), (3, ""), (4, "a" * 20_000), (4, "a" * 20_000), (None, " x")]
    got = tokens.encode_corpus(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == sorted((i or 0, len(whole.encode_ordinary(t or ""))) for i, t in rows)
    assert whole.decode(next(r.ids for r in got if r.doc_id == 1)) == rows[0][1]
    assert tokens.encode_corpus(docs(spark, [])).count() == 0


# Problem 9

SIZES = "doc_id bigint, n_tokens bigint, part string, bucket_ string"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=12), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, buckets):
    from itertools import combinations

    lengths = sorted(histogram)

    def padding(ends):
        return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())

    best = min(padding([*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k))
    ends = packing.optimal_boundaries(histogram, buckets)
    assert len(ends) <= buckets and padding(ends) == best


@pytest.mark.parametrize(("buckets", "run", "inside"), [(4, 1 << 20, False), (256, 1 << 20, False), (256, 7, False), (256, 50, True)])
def test_packing(spark, buckets, run, inside):
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 50, 700, 1025, 2048, 2049, 5000, rng.randrange(1, 3000)]) for _ in range(3000)] + [None]
    df = spark.createDataFrame([(i, n, "clash", "clash") for i, n in enumerate(sizes)], SIZES)
    rows = packing.pack(df, buckets=buckets, run=run, inside=inside).collect()
    used, parts = Counter(), defaultdict(list)
    for r in rows:
        used[r.container_id] += r.part_tokens
        parts[r.doc_id].append((r.part, r.token_from, r.part_tokens, r.n_parts))
    assert max(used.values()) <= 2048 and sum(used.values()) == sum(n or 0 for n in sizes)
    for i, n in enumerate(sizes):
        mine = sorted(parts[i])
        assert sum(p[2] for p in mine) == (n or 0) and len(mine) == mine[0][3] == max(1, -(-(n or 0) // 2048))
    if inside:
        assert max(len({r.bucket_end for r in rows if r.container_id == c and r.part_tokens}) for c in used) == 1
    elif buckets == 256:
        fill = packing.fill_report(packing.pack(df, buckets=buckets, run=run)).collect()[0]
        assert fill.fill > 0.96 and fill.fullest <= 2048
    assert packing.pack(df.where("false")).count() == 0
    assert packing.pack(df.where("n_tokens = 0")).count() == sum(n == 0 for n in sizes)


# Problem 10


def corpus(rng, n):
    own = {"law": "court judge verdict clause tenant".split(), "cooking": "oven onion butter stew garlic".split(), "music": "violin chord choir tempo octave".split()}

    def sentence(s):
        a, b = rng.sample(own[s], 2)
        return rng.choice([f"The reader saw the {a} near the {b}.", f"Every plan about the {a} begins with a {b}.", f"Nobody asked why the {b} and the {a} had come."])

    return own, sentence, [rng.choice(sorted(own)) for _ in range(n)]


def test_subjects_of_held_out_documents(spark):
    rng = random.Random(8)
    own, sentence, kinds = corpus(rng, 240)
    req = spark.createDataFrame([(f"r{i}", T0, None, " ".join(sentence(k) for _ in range(6)), f"https://e.example/{k}/x-{i}", None, [k.upper()], "clash") for i, k in enumerate(kinds)], "request_id string, received_at timestamp, title string, body string, url string, canonical_url string, tags array<string>, subjects string")
    rows, want = [], set()
    for i in range(90):
        a, b = rng.sample(sorted(own), 2)
        few = rng.choice([0, 1, 4])
        rows.append((i, "\n\n".join([" ".join(sentence(a) for _ in range(8)), " ".join(sentence(b) for _ in range(few))])))
        want |= {(i, a)} | ({(i, b)} if few / (8 + few) >= 0.25 else set())
    rows += [(900, None), (901, ""), (902, "qqq zzz kkk " * 30), (903, "word " * 100), (904, "- court\n- judge\n- verdict\n- clause"), (None, "The court saw the judge.")]
    want |= {(904, "law"), (None, "law")}
    labels = spark.createDataFrame([(i, " Law " if i % 2 else "music", "x") for i in range(0)] + [(904, " LAW", "r1"), (904, "unheard", "r2"), (None, None, None)], "doc_id bigint, subject string, labeller string")
    areas = spark.createDataFrame([("law",), ("cooking",), ("music",), (None,)], "subject string")
    got = {tuple(r) for r in subjects.document_subjects(docs(spark, rows), req, labels, areas).collect()}
    assert len(got ^ want) <= 0.03 * len(want)
    assert not any(i in (900, 901, 902, 903) for i, _ in got)
    assert subjects.document_subjects(docs(spark, []), req, labels, areas).count() == 0
    assert subjects.document_subjects(docs(spark, rows), req.where("false"), labels.where("false"), areas).count() == 0
    assert subjects.document_subjects(docs(spark, rows), req, labels, areas.where("false")).count() == 0


def test_units():
    assert subjects.units_of("## Head\n\nOne thing. Two\nthings here.\n\n- a\n- b\n\n```\ncode\n```") == [["One thing.", "Two things here."], ["- a", "- b"]]


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p6_found"])
def test_matches_sql(spark, data, name):
    from pathlib import Path

    import duckdb

    from folioforge.llm import catalog

    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    df = catalog.queries()[name](spark, data)
    cursor = c.execute(catalog.oracle_sql()[name])
    assert [d[0] for d in cursor.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())


def test_every_query_runs(spark, data):
    from folioforge.llm import catalog

    for name, q in catalog.queries().items():
        assert q(spark, data).count() >= 0, name
    assert np.array([1]).size
