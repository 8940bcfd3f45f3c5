"""Plug-ins: embedding and OCR providers as batched Arrow functions, with an embedder that needs no service."""

from __future__ import annotations

import hashlib
import math
import re
import shlex
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions.text import page_markdown

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Provider = Callable[[bytes | None, int], tuple[str, str | None]]
Parser = Callable[[bytes], Sequence[Mapping[str, object]]]
_WORD = re.compile(r"\w+(?:['-]\w+)*")
#: Fixed value: what precedes a question when it is embedded.
INSTRUCTION = "Instruct: Given a question, retrieve relevant source passages that answer it\nQuery: "


@lru_cache(maxsize=200_000)
def _place(word: str, dimensions: int) -> tuple[int, float]:
    h = int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)
    return h % dimensions, 1.0 if h // dimensions % 2 else -1.0


def hashed_vectors(texts: Sequence[str], dimensions: int = 64) -> list[list[float]]:
    """Unit vectors of hashed words, an embedder for tests and for search without a service; a text without words gets zeros."""
    out = []
    for text in texts:
        v = [0.0] * dimensions
        for w in _WORD.findall(text.lower()):
            at, sign = _place(w, dimensions)
            v[at] += sign
        size = math.sqrt(sum(x * x for x in v))
        out.append([x / size for x in v] if size else v)
    return out


def embed_column(text: Column, embedder: Embedder) -> Column:
    """A text column's vectors by a provider, row by row beside the other columns; null texts get null."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        there = texts.dropna()
        vectors = embedder(there.tolist()) if len(there) else []
        if len(vectors) != len(there):
            raise ValueError(f"{len(there)} texts, {len(vectors)} vectors")
        return pd.Series([list(map(float, v)) for v in vectors], index=there.index, dtype=object).reindex(texts.index).where(texts.notna(), None)

    return run(text)


def check_embedder(embedder: Embedder, probe: str = "health check") -> int:
    """The length of an embedder's vectors; raises if it gives none, none that are finite, or the wrong number."""
    vectors = embedder([probe])
    if len(vectors) != 1 or not len(vectors[0]) or not all(math.isfinite(x) for x in vectors[0]):
        raise ValueError("the embedder gives no usable vector")
    return len(vectors[0])


def command_provider(template: str, model: str, folder: str, timeout: float = 900, values: Mapping[str, str] | None = None) -> Provider:
    """An OCR provider that runs a command on the worker, once a page.

    The template holds {input_image}, {output_md}, {output_json}, {page_number}, {source_id}, {base_url} and {model_name}; it is split into words before they are filled
    in, so no value is read by a shell. The text is what the command writes to output_md, else its standard output. ``folder`` is the worker's scratch folder for the page's
    two files, removed after each page.
    """
    words = shlex.split(template)

    def run(content: bytes | None, number: int) -> tuple[str, str | None]:
        with tempfile.TemporaryDirectory(dir=folder) as here:
            image, out = Path(here, "page.img"), Path(here, "page.md")
            image.write_bytes(content or b"")
            filled = {"base_url": "", "source_id": "", **(values or {}), "input_image": str(image), "output_md": str(out), "output_json": str(Path(here, "page.json")), "page_number": str(number), "model_name": model}
            done = subprocess.run([w.format(**filled) for w in words], capture_output=True, text=True, timeout=timeout, check=False)
            if done.returncode:
                raise RuntimeError(f"the OCR command ended with {done.returncode}: {done.stderr.strip()[-300:]}")
            return (out.read_text(encoding="utf-8") if out.exists() else done.stdout), model

    return run


class ReadyProviders:
    """Providers by name, each probed once before its first use; a provider that fails its probe is an error, never replaced by another."""

    def __init__(self, providers: Mapping[str, Provider], probes: Mapping[str, Callable[[], None]] | None = None):
        self.providers, self.probes, self.ready = dict(providers), dict(probes or {}), set()

    def get(self, mode: str, default: str) -> Provider:
        name = default if mode in ("auto", "always") else mode
        provider = choose_provider(mode, self.providers, default)
        if name not in self.ready:
            if probe := self.probes.get(name):
                probe()
            self.ready.add(name)
        return provider


def embed_with(df: DataFrame, id_col: str, text_col: str, embedder: Embedder, batch: int = 8) -> DataFrame:
    """(id, embedding, embedding_dimension) by a provider called with ``batch`` texts at a time; vectors are matched by id, a wrong count is an error."""
    src = df.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).where("text_ is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                vectors = embedder(part.column(1).to_pylist())
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{part.num_rows} texts, {len(vectors)} vectors")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32())), pa.array([len(v) for v in vectors], pa.int32())], ["id_", "embedding", "embedding_dimension"])

    kind = dict(src.dtypes)["id_"]
    return src.mapInArrow(run, f"id_ {kind}, embedding array<float>, embedding_dimension int").withColumnRenamed("id_", id_col)


def read_scans(pages: DataFrame, provider: Provider, name: str, blank: str = "blank", continue_on_error: bool = False) -> DataFrame:
    """Pages (source_id, page_number, content BINARY, blank BOOLEAN) read by an OCR provider.

    Gives source_id, page_number, markdown, extraction_method, ocr_provider, ocr_model, quality_flags. A blank page is skipped. An
    empty answer or an exception fails the run, or with continue_on_error the page, whose text then tells why.
    """
    src = pages.select("source_id", "page_number", "content", F.col(blank).alias("blank_"))

    def one(content: bytes | None, number: int, empty: bool) -> tuple:
        if empty:
            return "", "skipped", None, None, ["blank_page"]
        try:
            text, model = provider(content, number)
            if not text.strip():
                raise ValueError("no text was read")
            return text, "ocr", name, model, []
        except Exception as e:
            if not continue_on_error:
                raise
            return f"[OCR failed: {e}]", "failed", name, None, ["ocr_failed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
        for b in batches:
            got = [one(*x) for x in zip(*(b.column(k).to_pylist() for k in (2, 1, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([g[k] for g in got], t) for k, t in enumerate(kinds))], ["source_id", "page_number", "text", "extraction_method", "ocr_provider", "ocr_model", "quality_flags"])

    out = src.mapInArrow(run, "source_id string, page_number int, text string, extraction_method string, ocr_provider string, ocr_model string, quality_flags array<string>")
    return out.withColumn("markdown", page_markdown(F.col("text"), F.col("page_number"))).drop("text")


def scan_pages(files: DataFrame, parser: Parser) -> DataFrame:
    """Pages of documents (source_id, content BINARY) by a parser: source_id, page_number, page_index, text, has_images, drawings, dark, pixels, error.

    The parser is called once a document, with its bytes, and gives a mapping a page; what it leaves out counts as none. A document it cannot read gives one row with the error and no page.
    """
    fields = (("text", "", pa.string()), ("has_images", False, pa.bool_()), ("drawings", 0, pa.int64()), ("dark", 0, pa.int64()), ("pixels", 0, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                try:
                    found, error = list(parser(b.column(1)[i].as_py() or b"")), None
                except Exception as e:  # one unreadable document does not end the run
                    found, error = [], str(e).strip() or type(e).__name__
                n = len(found) or (1 if error else 0)
                numbers = [k + 1 for k in range(len(found))] or [None] * n
                cols = [pa.array([p.get(name, default) for p in found] or [None] * n, kind) for name, default, kind in fields]
                index = [None if k is None else k - 1 for k in numbers]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * n, pa.string()), pa.array(numbers, pa.int32()), pa.array(index, pa.int32()), *cols, pa.array([error] * n, pa.string())], ["source_id", "page_number", "page_index", *(f[0] for f in fields), "error"])

    return files.select(F.col("source_id").cast("string"), "content").mapInArrow(run, "source_id string, page_number int, page_index int, text string, has_images boolean, drawings bigint, dark bigint, pixels bigint, error string")


def choose_provider(mode: str, providers: dict[str, Provider], default: str) -> Provider:
    """Provider of a mode: the default for auto and always, else the one of that name; there is no fallback."""
    wanted = default if mode in ("auto", "always") else mode
    if wanted not in providers:
        raise KeyError(f"no OCR provider {wanted!r}")
    return providers[wanted]


def layout_fallback(pages: DataFrame) -> DataFrame:
    """Pages with layout text (layout, layout_error) and plain text (plain): the text to take and how it was read.

    A failed or empty layout falls back to the plain text with a flag; ``fatal`` marks a page whose predecessor in
    the source failed too.
    """
    failed = F.col("layout_error").isNotNull()
    before = F.lag(failed, 1, False).over(W.partitionBy("source_id").orderBy("page_number"))
    empty = ~failed & (F.trim(F.coalesce("layout", F.lit(""))) == "")
    flag = F.when(failed, F.concat(F.lit("layout_failed:"), F.col("layout_error"))).when(empty, "layout_empty")
    return pages.select(
        "source_id", "page_number", F.when(failed | empty, F.col("plain")).otherwise(F.col("layout")).alias("text"), F.when(failed | empty, "pymupdf").otherwise("pymupdf4llm").alias("extraction_method"),
        F.array_compact(F.array(flag)).alias("quality_flags"), (failed & before).alias("fatal"),
    )


def numbered_images(files: DataFrame) -> DataFrame:
    """Image files of each folder with page numbers by name."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return files.where("kind = 'image'").withColumn("folder", folder).withColumn("page_number", F.row_number().over(W.partitionBy("folder").orderBy("path")))


def folder_hash(files: DataFrame) -> DataFrame:
    """(folder, content_sha256): hash over the files' names and contents, a zero byte after each, in order of name.

    A folder's files stream through one task in order; no more than one Arrow batch of them is held.
    """
    parts = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("n"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, digest = None, hashlib.sha256()
        for b in batches:
            for i in range(b.num_rows):
                at, name, content = (b.column(k)[i].as_py() for k in range(3))
                if at != folder:
                    if folder is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([digest.hexdigest()])], ["folder", "content_sha256"])
                    folder, digest = at, hashlib.sha256()
                for piece in (name.encode(), b"\0", content or b"", b"\0"):
                    digest.update(piece)
        if folder is not None:
            yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([digest.hexdigest()])], ["folder", "content_sha256"])

    return parts.repartition("folder").sortWithinPartitions("folder", "n").mapInArrow(run, "folder string, content_sha256 string")
