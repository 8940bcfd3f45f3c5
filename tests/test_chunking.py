"""Units, packing and splitting against facts and an independent slow reading of the rules."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.operators.chunking import chunk_sources, describe_chunks, pack, split_documents, split_long, units_of
from folioforge.plans.config import Chunking

WORDS = ["alpha", "beta", "gamma", "x" * 40, "delta epsilon"]
PARTS = st.lists(
    st.one_of(
        st.integers(1, 9).map(lambda n: f"<!-- page: {n} -->"), st.integers(1, 9).map(lambda n: f"## Page {n}"), st.integers(1, 4).map(lambda n: f"# Chapter {n} of it"),
        st.just("# Plain heading"), st.just("## Sub *part*"), st.just("In words: this chapter covers it"), st.lists(st.sampled_from(WORDS), min_size=1, max_size=60).map(" ".join),
    ),
    max_size=14,
)


def slow_split(text: str, target: int, overlap: int) -> list[str]:
    """Walks character by character."""
    if len(text) <= target:
        return [text.strip()]
    out, a = [], 0
    while a < len(text):
        b = a + target
        if b >= len(text):
            b = len(text)
        else:
            for k in range(b - 1, a + max(200, target // 2), -1):
                if text[k] in " \n":
                    b = k + 1
                    break
        if text[a:b].strip():
            out.append(text[a:b].strip())
        if b == len(text):
            break
        a = max(b - overlap, a + 1)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=3000), st.integers(50, 900), st.integers(0, 49))
def test_split_equals_slow_reading(text, target, overlap):
    assert [text[a:b].strip() for a, b in split_long(text, target, overlap) if text[a:b].strip()] == [x for x in slow_split(text, target, overlap) if x]


@settings(max_examples=150, deadline=None)
@given(PARTS, st.sampled_from(["\n\n", "\n \n", "\n"]))
def test_invariants(parts, glue):
    sizes = Chunking(target=300, overlap=40, minimum=60)
    text = glue.join(parts)
    chunks = pack(text, sizes)
    assert all(c.text.strip() for c in chunks)
    said = set(re.findall(r"\w+", text))
    kept = set(re.findall(r"\w+", " ".join(c.text for c in chunks)))
    assert {w for w in said if len(w) < 41} <= kept | {w for w in said if any(w in k for k in kept)}
    assert all(c.pages == sorted(c.pages) or len(set(c.pages)) > 1 for c in chunks)
    units = units_of(text)
    assert "".join("".join(u.split()) for u in units.text) == "".join(text.split())


def test_pages_and_chapters():
    text = "# **CHAPTER 1 The start**\n\nfirst words\n\n<!-- page: 2 -->\n\n## Page 2\n\n# **CHAPTER 2 The end**\n\nlast words"
    chunks = pack(text, Chunking(target=2000, overlap=0, minimum=50))
    assert [c.chapter for c in chunks] == ["CHAPTER 1 The start", "CHAPTER 2 The end"]
    assert chunks[0].pages == [] and set(chunks[1].pages) == {2}


def test_untitled_chapter_and_last_section():
    chunks = pack("# Graphs\n\n## _This chapter covers_\n\n- edges", Chunking())
    assert [c.chapter for c in chunks] == ["Chapter 1: Graphs"]
    assert chunks[0].section == "_This chapter covers_"


def test_page_joined_by_single_line_feed():
    text = "<!-- page: 1 -->\n\nends here\n<!-- page: 2 -->\n\nnext"
    assert units_of(text).page == [2, 2]
    assert units_of(text, strict_page_boundaries=True).page == [1, 2]


def test_overflow_keeps_overlap_and_page():
    text = "<!-- page: 1 -->\n\n" + "a" * 250 + "\n\n<!-- page: 2 -->\n\n" + "b" * 250
    one, two = pack(text, Chunking(target=300, overlap=20, minimum=50))
    assert two.text.startswith("a" * 20) and two.pages == [1, 2]
    assert one.pages == [1]


def test_long_unit_has_no_overlap_with_others():
    text = "short one\n\n" + "word " * 200 + "\n\nshort two"
    chunks = pack(text, Chunking(target=300, overlap=30, minimum=5))
    assert chunks[0].text == "short one" and chunks[-1].text == "short two"


def test_tables(spark):
    schema = "id string, text string, source string, chunk_index int"
    src = spark.createDataFrame([("s1", "# 1: One\n\n<!-- page: 3 -->\n\nwords", "clash", 9), ("s2", None, None, None), ("s3", "", None, 1)], schema)
    packed = chunk_sources(src, "id", "text")
    assert [(r.source, r.chunk_index, r.inferred_chapter) for r in packed.collect()] == [("s1", 0, "1: One")]
    manifests = spark.createDataFrame([("s1", None, "T"), ("s9", "Own", "U")], "source_id string, chapter string, title string")
    pages = spark.createDataFrame([("s1", 3, "ocr", "m")], "source_id string, page_number int, extraction_method string, ocr_model string")
    r = describe_chunks(packed, manifests, pages).collect()[0]
    assert (r.chunk_id, r.extraction_method, r.ocr_model, r.page_start, r.title) == ("s1_ch1_one_p0003_0000", "ocr", "m", 3, "T")
    empty = spark.createDataFrame([], schema)
    assert chunk_sources(empty, "id", "text").count() == 0 and split_documents(empty, "id", "text").count() == 0
    wide = packed.withColumn("chunk_index", F.lit(12345))
    assert describe_chunks(wide, manifests, pages).collect()[0].chunk_id.endswith("_12345")


def test_configuration():
    from folioforge.plans.config import Retrieval, load_settings

    s = load_settings({"chunking": {"target": 800}}, {"FOLIOFORGE_QUEUE__MAX_ACTIVE": "3", "OTHER": "1"})
    assert (s.chunking.target, s.queue.max_active, s.retrieval.top_k) == (800, 3, 12)
    with pytest.raises(ValueError):
        load_settings({"llm": {}}, {})
    with pytest.raises(ValueError):
        Retrieval(alpha=2.0)
