"""Readers of inputs: texts, Markdown with front matter, articles, job and chunk records, binary files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.text import SPACE, strip

_S, _TS = T.StringType(), T.TimestampType()
METADATA = [
    T.StructField("tags", T.ArrayType(_S)), *[T.StructField(c, _S) for c in ("origin", "publisher", "author", "created_at_source", "updated_at_source", "retrieved_at", "url", "canonical_url", "external_id", "collection", "summary")],
]
ARTICLE = T.StructType([T.StructField("request_id", _S), T.StructField("received_at", _TS), T.StructField("title", _S), T.StructField("body", _S), T.StructField("source_type", _S), T.StructField("language", _S), *METADATA, T.StructField("no_index", T.BooleanType()), T.StructField("duplicate_policy", _S)])
CHUNK = T.StructType([
    *[T.StructField(c, _S) for c in ("chunk_id", "source_id", "source_type", "title", "chapter", "section")], *[T.StructField(c, T.IntegerType()) for c in ("page_start", "page_end", "chunk_index")],
    *[T.StructField(c, _S) for c in ("text", "file_path", "extraction_method", "ocr_model", "language")], *METADATA, T.StructField("embedding_model", _S), T.StructField("embedding_dimension", T.IntegerType()),
    T.StructField("chunker_version", _S), T.StructField("created_at", _TS), T.StructField("embedding", T.ArrayType(T.FloatType())),
])
JOB = T.StructType([
    *[T.StructField(c, _S) for c in ("job_id", "status", "phase", "filename", "upload_path", "title", "source_id", "identity_key")], T.StructField("attempts", T.IntegerType()),
    *[T.StructField(c, _S) for c in ("claim_token", "worker_id", "error")], *[T.StructField(c, _TS) for c in ("created_at", "updated_at", "started_at", "finished_at", "next_attempt_at")], T.StructField("duplicate_policy", _S),
])
FRONT = "title string, source_type string, language string, chapter string, tags array<string>, origin string, publisher string, author string, url string, canonical_url string, external_id string, collection string, summary string, created_at_source string, updated_at_source string, retrieved_at string"
#: Kinds of input by file name ending.
KINDS = {"pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "tif", "tiff", "webp", "bmp"), "markdown": ("md", "markdown"), "text": ("txt",)}


def input_kind(path: Column) -> Column:
    """pdf, image, markdown or text by a path's ending; null if unsupported."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, endings in KINDS.items():
        out = F.when(ending.isin(*endings), kind).otherwise(out)
    return out


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, blank) of whole text files, a byte order mark gone; see ``with_text`` for those that can be used."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return rows.withColumn("blank", strip(F.col("text")) == "")


def read_binary(spark: SparkSession, path: str, most_bytes: int, pattern: str = "*") -> DataFrame:
    """Files that are accepted, with kind and content hash; see ``refused_files`` for the others."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    kept = rows.where(refusal(F.col("path"), F.col("length"), most_bytes).isNull())
    return kept.withColumn("kind", input_kind(F.col("path"))).withColumn("content_sha256", F.sha2("content", 256))


def refusal(path: Column, length: Column, most_bytes: int) -> Column:
    """Why an input is refused: unsupported (by its ending), blank (no bytes) or too_large; null if it is accepted."""
    return F.when(input_kind(path).isNull(), "unsupported").when(length == 0, "blank").when(length > most_bytes, "too_large")


def refused_files(spark: SparkSession, path: str, most_bytes: int, pattern: str = "*") -> DataFrame:
    """(path, length, reason) of files that are refused; their contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    return rows.withColumn("reason", refusal(F.col("path"), F.col("length"), most_bytes)).where("reason is not null")


def require_accepted(files: DataFrame, most_bytes: int) -> DataFrame:
    """Files (path, length, ...); reading them raises at the first that is refused."""
    why = refusal(F.col("path"), F.col("length"), most_bytes)
    return files.where(F.when(why.isNotNull(), F.raise_error(F.concat(why, F.lit(": "), F.col("path"))).isNull()).otherwise(F.lit(True)))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article requests from JSON lines; those without a body are left out."""
    return spark.read.schema(ARTICLE).json(path).where(F.coalesce(strip(F.col("body")), F.lit("")) != "")


def with_text(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts that can be used, (path, reason) of blank ones) of ``read_texts``."""
    return texts.where(~F.col("blank")).drop("blank"), texts.where("blank").select("path", F.lit("blank").alias("reason"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON lines, blank lines skipped; a path without files gives no rows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return spark.read.schema(schema).json(path) if found else spark.createDataFrame([], schema)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records with an id; none if there is no file."""
    return read_json_lines(spark, path, CHUNK).where("chunk_id is not null")


def scan_source(chunks: DataFrame, source_id: str, after: str | None = None, page: int = 100, vectors: bool = False) -> DataFrame:
    """The next ``page`` rows of a source in order of chunk_id, those after a cursor; vectors only if asked for. Filter, cursor and columns reach the scan."""
    rows = chunks.where(F.col("source_id") == source_id)
    rows = rows if after is None else rows.where(F.col("chunk_id") > after)
    return (rows if vectors else rows.drop("embedding")).orderBy("chunk_id").limit(page)


def read_jobs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(jobs in order of creation, corrupt records) from JSON lines."""
    schema = T.StructType([*JOB.fields, T.StructField("corrupt_", _S)])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt_").json(path)
    bad = F.col("corrupt_").isNotNull() | F.col("job_id").isNull()
    return rows.where(~bad).drop("corrupt_").orderBy("created_at", "job_id"), rows.where(bad).select("corrupt_")


def split_front_matter(df: DataFrame, text: str) -> DataFrame:
    """Adds yaml, body and front_error. A text that begins with a line --- must close it by --- or ...; else body is the text."""
    shape = r"(?s)\A---[ \t]*\r?\n(.*?)(?:(?<=\n)|\A)(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)(.*)\z"
    opens = F.col(text).rlike(r"\A---[ \t]*(\r?\n|\z)")
    closed = F.col(text).rlike(shape)
    return df.withColumn("yaml", F.when(opens & closed, F.regexp_extract(text, shape, 1))).withColumn("body", F.when(opens & closed, F.regexp_extract(text, shape, 2)).when(~opens, F.col(text))).withColumn("front_error", F.when(opens & ~closed, "front matter is not closed"))


def parse_front_matter(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, front STRUCT, body, front_error) of Markdown texts; unknown keys are dropped, dates kept as written.

    An error names invalid YAML, a value that is no mapping, or tags of the wrong kind; front is then null.
    """
    parts = split_front_matter(df.select(F.col(id_col).cast("string").alias("id_"), F.col(text).alias("t_")), "t_").select("id_", "yaml", "body", "front_error")
    names = [x.split()[0] for x in FRONT.split(", ")]
    kind = pa.struct([(n, pa.list_(pa.string()) if n == "tags" else pa.string()) for n in names])

    def read(source: str | None) -> tuple[dict | None, str | None]:
        import yaml

        if source is None:
            return None, None
        try:
            loaded = yaml.load(source, Loader=yaml.BaseLoader) or {}  # scalars stay as written
        except yaml.YAMLError as e:
            return None, f"invalid YAML: {type(e).__name__}"
        if not isinstance(loaded, dict):
            return None, "front matter is no mapping"
        out = {n: None if loaded.get(n) in (None, "", "null", "~") else loaded[n] for n in names}
        tags = out["tags"]
        if isinstance(tags, str):
            if tags.strip().lstrip("-").replace(".", "").isdigit():
                return None, "tags must be text or a list of texts"
            tags = tags.split(",")
        if tags is not None and not (isinstance(tags, list) and all(isinstance(t, str) for t in tags)):
            return None, "tags must be text or a list of texts"
        out["tags"] = [p.strip() for t in tags or [] for p in t.split(",") if p.strip()]
        if bad := [n for n in names if n != "tags" and out[n] is not None and not isinstance(out[n], str)]:
            return None, f"{bad[0]} must be text"
        return out, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read(y) for y in b.column(1).to_pylist()]
            errors = [e or mine for e, (_, mine) in zip(b.column(3).to_pylist(), got)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g for g, _ in got], kind), b.column(2), pa.array(errors, pa.string())], ["id_", "front", "body", "front_error"])

    return parts.mapInArrow(run, f"id_ string, front struct<{', '.join(x.replace(' ', ':', 1) for x in FRONT.split(', '))}>, body string, front_error string").withColumnRenamed("id_", id_col)


def resolve_metadata(df: DataFrame, explicit: dict[str, Column], defaults: dict[str, str] | None = None) -> DataFrame:
    """Adds each field as explicit value, else front matter, else default; an empty string counts as given."""
    base = {"source_type": "other", "language": "unknown"} | (defaults or {})
    out = df
    for name in (x.split()[0] for x in FRONT.split(", ")):
        values = [v for v in (explicit.get(name), F.col(f"front.{name}"), F.lit(base[name]) if name in base else None) if v is not None]
        out = out.withColumn(name, F.coalesce(*values))
    return out.withColumn("has_title", F.coalesce(F.length(F.regexp_replace("title", SPACE, "")) > 0, F.lit(False)))


def ocr_response_markdown(response: Column) -> Column:
    """Text of a chat-style OCR answer: the first choice's content, list parts joined by line feeds; null if empty."""
    plain = F.get_json_object(response, "$.choices[0].message.content")
    parts = F.from_json(plain, "array<struct<text:string>>")
    text = F.when(F.ltrim(plain).startswith("["), F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).otherwise(plain)
    return F.nullif(strip(text), F.lit(""))


def embedding_response(response: Column) -> Column:
    """Vectors of an embedding answer in order of their index."""
    rows = F.from_json(F.get_json_object(response, "$.data"), "array<struct<index:int,embedding:array<double>>>")
    return F.transform(F.array_sort(rows), lambda r: r["embedding"])


def ordered_ocr_lines(observations: Column) -> Column:
    """Text of OCR observations (text, x, y with y upwards), top to bottom, left to right within a line; blank ones dropped."""

    def before(a: Column, b: Column) -> Column:
        apart = F.abs(a["y"] - b["y"]) > 0.01
        return F.when(apart, F.when(a["y"] > b["y"], -1).otherwise(1)).otherwise(F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0))

    kept = F.filter(observations, lambda o: strip(o["text"]) != "")
    return F.array_join(F.transform(F.array_sort(kept, before), lambda o: o["text"]), "\n")


def service_health(status: Column, models: Column, props: Column, model: str | None, multimodal: bool = False) -> Column:
    """What is wrong with an OCR service by its three answers (health, models, properties as JSON); null if nothing is.

    Its status must be ok; the configured model must be among its models and be its alias; with ``multimodal`` it must say that it sees images.
    """
    ids = F.transform(F.from_json(F.get_json_object(models, "$.data"), "array<struct<id:string>>"), lambda m: m["id"])
    alias = F.get_json_object(props, "$.model_alias")
    sees = F.lower(F.coalesce(F.get_json_object(props, "$.modalities.vision"), F.lit("false"))) == "true"
    said = F.concat_ws(" ", F.coalesce(F.get_json_object(models, "$.data[0].capabilities"), F.lit("")), F.coalesce(F.get_json_object(models, "$.models[0].capabilities"), F.lit("")))
    out = F.when(~F.coalesce(F.get_json_object(status, "$.status") == "ok", F.lit(False)), "not ready")
    if model is not None:
        out = out.when(~F.coalesce(F.array_contains(ids, model), F.lit(False)), "model is not loaded").when(~F.coalesce(alias == model, F.lit(False)), "another model answers")
    return out.when(~(sees | F.lower(said).contains("multimodal")), "no vision") if multimodal else out
