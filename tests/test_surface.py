"""The Python and command-line surface, the worker, refusals, index writing, settings and plug-ins."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from folioforge import __main__ as cli
from folioforge import api
from folioforge.operators import chunking, generations, queue
from folioforge.plans import config, runtime
from folioforge.sources import plugins, readers, writers
from folioforge.sources.store import PublicationError, VersionedTable
from folioforge.streaming.worker import Worker


def test_engine_answers(spark, data):
    e = api.Engine(spark, data)
    sources = e.sources().collect()
    assert [s.source_id for s in sources] == sorted(s.source_id for s in sources) and sources
    assert e.source(sources[0].source_id).count() == 1
    own = e.chunks(spark.read.parquet(f"{data}/chunks.parquet").where("source_id is not null").first().source_id).collect()
    assert own and e.chunks().count() >= len(own) and e.chunk(own[0].chunk_id).count() == 1
    assert e.health().collect()[0].sources == len(sources)
    hits = e.search("how do routers pass packets", top_k=3).collect()
    assert sorted(h["rank"] for h in hits) == [1, 2, 3]
    assert e.context("how do routers pass packets", top_k=3).collect()[0].sources == 3
    job = spark.read.parquet(f"{data}/jobs.parquet").where("status = 'failed'").first()
    assert "claim_token" not in e.job(job.job_id).columns
    for missing in (lambda: e.source("no"), lambda: e.chunk("no"), lambda: e.job("no"), lambda: e.retry("no", spark.createDataFrame([], "upload_path string"))):
        with pytest.raises(api.NotFound):
            missing()
    with pytest.raises(api.BadRequest):
        e.search("")
    requests = spark.read.parquet(f"{data}/article_requests.parquet")
    decided = {r.decision for r in e.submit(requests).select("decision").distinct().collect()}
    assert "accepted" in decided and decided <= {"accepted", "rejected", "invalid"}
    assert e.backfill().count() == len(sources) and set(e.index_faults().columns) == {"fault", "rows"}


def test_refusals_have_a_status():
    assert {k: api.refuse(k).status for k in ("too_large", "queue_full", "unsupported", "unknown", "rejected", "blank")} == {"too_large": 413, "queue_full": 429, "unsupported": 415, "unknown": 404, "rejected": 409, "blank": 400}
    assert api.refuse("other", "x").status == 500 and str(api.refuse("other", "x")) == "other: x"


def test_command_line(spark, data, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    assert cli.main(["--settings", str(tmp_path / "s.yaml"), data, "init"]) == 0
    assert config.read_settings(tmp_path / "s.yaml", environment={}) == config.Settings()
    assert cli.main([data, "search", "routers pass packets", "--top-k", "2", "--language", "en"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main([data, "source", "none-such"]) == 1 and "404" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main([data])


JOBS = "job_id string, status string, phase string, source_id string, identity_key string, attempts int, claim_token string, worker_id string, error string, upload_path string, created_at timestamp, updated_at timestamp, started_at timestamp, finished_at timestamp, next_attempt_at timestamp"


def test_worker_runs_jobs_to_their_end(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [(str(i), s, p, None, None, 0, None, None, None, None, t + timedelta(i), t, None, None, None) for i, (s, p) in enumerate([("queued", "queued"), ("running", "embedding"), ("queued", "queued"), ("succeeded", "done"), ("queued", "queued")])]
    table = VersionedTable(spark, f"file://{tmp_path}/jobs")
    table.publish(spark.createDataFrame(rows, JOBS), "job_id")
    seen = []

    def phase(name):
        def work(job):
            seen.append((job.job_id, name))
            if job.job_id == "2":
                raise ValueError("vector dimension mismatch")
            if job.job_id == "4" and name == "indexing":
                raise RuntimeError("connection refused")

        return work

    w = Worker(table, {n: phase(n) for n in ("extracting", "embedding", "indexing")}, "w1", clock=lambda: datetime(2025, 2, 1, tzinfo=timezone.utc))
    assert w.run(once=True) == ["0", "1", "2", "4"]
    got = {r.job_id: (r.status, r.phase, r.attempts) for r in table.read().collect()}
    assert got == {"0": ("succeeded", "done", 1), "1": ("succeeded", "done", 1), "2": ("failed", "extracting", 1), "3": ("succeeded", "done", 0), "4": ("queued", "indexing", 1)}
    assert ("1", "extracting") not in seen and ("1", "embedding") in seen  # resumed where it was
    four = table.read().where("job_id = '4'").collect()[0]
    assert four.next_attempt_at == datetime(2025, 2, 1, 0, 0, 10) and four.worker_id is None
    with VersionedTable(spark, f"{table.root}.worker").lock("other"), pytest.raises(PublicationError, match="held by other"):
        w.run(once=True)


def test_a_lost_claim_is_noticed(spark, tmp_path):
    t = datetime(2025, 1, 1)
    table = VersionedTable(spark, f"file://{tmp_path}/jobs")
    table.publish(spark.createDataFrame([("1", "queued", "queued", None, None, 0, None, None, None, None, t, t, None, None, None)], JOBS), "job_id")

    def steal(job):
        table.publish(queue.recover_interrupted(table.read()), "job_id")

    w = Worker(table, {"extracting": steal, "embedding": steal, "indexing": steal}, "w1")
    with pytest.raises(RuntimeError, match="was lost"):
        w.step()
    assert table.read().collect()[0].status == "queued"


def test_inputs_are_accepted_or_refused(spark, tmp_path):
    for name, content in (("a.md", "x"), ("b.exe", "x"), ("c.txt", ""), ("d.pdf", "y" * 50)):
        (tmp_path / name).write_text(content)
    accepted = readers.read_binary(spark, str(tmp_path), 40).select(F.regexp_extract("path", r"(\w+\.\w+)$", 1).alias("n"), "kind").collect()
    assert [tuple(r) for r in accepted] == [("a.md", "markdown")]
    refused = {r.path[-5:]: r.reason for r in readers.refused_files(spark, str(tmp_path), 40).collect()}
    assert refused == {"b.exe": "unsupported", "d.pdf": "too_large"}  # the scan itself passes files without bytes over
    why = spark.createDataFrame([("c.txt", 0), ("c.txt", 40), ("c", 1)], "path string, length bigint").select(readers.refusal(F.col("path"), F.col("length"), 40))
    assert [r[0] for r in why.collect()] == ["blank", None, "unsupported"]
    with pytest.raises(Exception, match="unsupported"):
        readers.require_accepted(spark.createDataFrame([("x.exe", 3)], "path string, length bigint"), 40).collect()
    (tmp_path / "e.txt").write_text(" \n")
    used, blank = readers.with_text(readers.read_texts(spark, str(tmp_path)))
    assert used.count() == 3 and [r.reason for r in blank.collect()] == ["blank"]
    assert readers.read_chunks(spark, f"file://{tmp_path}/none/*.jsonl").count() == 0


def test_scan_by_pages(spark):
    rows = spark.createDataFrame([(f"c{i:02d}", "s" if i % 2 else "t", [1.0]) for i in range(30)], "chunk_id string, source_id string, embedding array<float>")
    seen, after = [], None
    while page := readers.scan_source(rows, "s", after, 4).collect():
        assert "embedding" not in page[0].asDict()
        seen += [r.chunk_id for r in page]
        after = seen[-1]
    assert seen == [f"c{i:02d}" for i in range(1, 30, 2)]
    assert readers.scan_source(rows, "s", vectors=True).columns[-1] == "embedding"


def test_index_keys_and_faults(spark):
    ids = ["a", "chunk-1", "å/ö", ""]
    df = spark.createDataFrame([(i,) for i in ids], "chunk_id string")
    assert {r.chunk_id: r.k for r in df.select("chunk_id", generations.object_key(F.col("chunk_id")).alias("k")).collect()} == {i: str(uuid.uuid5(uuid.NAMESPACE_DNS, i)) for i in ids}
    rows = [("a", "s", "x", [1.0], 1), (None, "s", "x", [1.0], 1), ("c", "s", None, [1.0], 1), ("d", "s", "x", None, 1), ("e", "s", "x", [float("nan")], 1), ("f", "s", "x", [1.0], 2), ("a", "z", "x", [1.0], 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_id string, text string, embedding array<float>, embedding_dimension int")
    assert {(r.chunk_id, r.fault) for r in generations.object_faults(chunks).collect()} == {(None, "no_id"), ("c", "no_text"), ("d", "no_vector"), ("e", "bad_vector"), ("f", "wrong_length")}
    assert {r.fault: r.rows for r in generations.snapshot_faults(chunks, spark.createDataFrame([("s",)], "source_id string")).collect()} == {"no_id": 1, "no_text": 1, "no_vector": 1, "bad_vector": 1, "wrong_length": 1, "two_sources": 1, "unknown_source": 1}
    made = generations.index_properties(spark.createDataFrame([("a", None, 1)], "chunk_id string, section string, own int"), F.lit("now")).collect()[0].properties
    assert made == '{"chunk_id":"a","created_at":"now"}'


def test_deletion_is_complete_or_an_error(spark):
    before = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t"), ("d", None)], "chunk_id string, source_id string")
    assert generations.require_deleted(before, before.where("source_id is null or source_id <> 's'"), "s") == 2
    for bad in (before, before.where("source_id = 't'"), before.where("false")):
        with pytest.raises(RuntimeError, match="not complete"):
            generations.require_deleted(before, bad, "s")


def test_a_source_is_published_whole_or_not(spark, tmp_path):
    index = VersionedTable(spark, f"file://{tmp_path}/index")
    schema = "chunk_id string, source_id string, text string, embedding array<float>, embedding_dimension int"
    make = lambda *ids, source="s", vector=(1.0,): spark.createDataFrame([(i, source, "x", list(vector) if vector else None, 1) for i in ids], schema)
    manifest = lambda s: spark.createDataFrame([(s, "T")], "source_id string, title string")
    assert generations.publish_source(index, "s", make("a", "b"), manifest("s")) == 1
    generations.publish_source(index, "t", make("c", source="t"), manifest("t"))
    generations.publish_source(index, "s", make("b", "d"), manifest("s"))
    assert sorted(r.chunk_id for r in index.read(part="chunks").collect()) == ["b", "c", "d"] and index.read(part="sources").count() == 2
    now = index.current()
    for bad in (make("x", source="other"), make("x", vector=None), make("x").where("false")):
        with pytest.raises(ValueError):
            generations.publish_source(index, "s", bad)
    for twice in (make("x", "x"), make("c")):
        with pytest.raises(PublicationError):
            generations.publish_source(index, "s", twice)
    assert index.current() == now and index.recover() == []


def test_settings_files(tmp_path):
    f, env = tmp_path / "s.yaml", tmp_path / ".env"
    f.write_text("chunking:\n  target_chars: 800\nsearch:\n  alpha: 0.5\n")
    env.write_text("# x\nexport FOLIOFORGE_CHUNKING__OVERLAP='90'\nFOLIOFORGE_RETRIEVAL__ALPHA=0.7\n\nOTHER=1\n")
    with pytest.warns(UserWarning, match="now called"):
        s = config.read_settings(f, env, {"FOLIOFORGE_RETRIEVAL__ALPHA": "0.25"})
    assert (s.chunking.target, s.chunking.overlap, s.retrieval.alpha) == (800, 90, 0.25)
    assert config.read_settings(tmp_path / "none.yaml", environment={}) == config.Settings()
    f.write_text("- a")
    with pytest.raises(ValueError):
        config.read_settings(f, environment={})
    f.write_text("chunking: {target: 1, target_chars: 2}")
    with pytest.raises(ValueError, match="twice"):
        config.read_settings(f, environment={})
    assert config.write_settings(f).read_text().startswith("chunking: {") and "detection" in config.write_settings(f, overwrite=True).read_text()


def test_embedding_column_and_probe(spark):
    df = spark.createDataFrame([("a", "red lamp"), ("b", None), ("c", "")], "id string, text string")
    got = {r.id: r.v for r in df.select("id", plugins.embed_column(F.col("text"), plugins.hashed_vectors).alias("v")).collect()}
    assert got["b"] is None and got["a"] == plugins.hashed_vectors(["red lamp"])[0] and got["c"] == [0.0] * 64
    assert plugins.check_embedder(plugins.hashed_vectors) == 64
    for bad in (lambda t: [], lambda t: [[]], lambda t: [[float("nan")]]):
        with pytest.raises(ValueError):
            plugins.check_embedder(bad)


def test_command_provider(spark, tmp_path):
    (tmp_path / "ocr.py").write_text("import sys\nopen(sys.argv[2], 'w').write('read ' + open(sys.argv[1]).read() + ' ' + sys.argv[3])\n")
    import sys

    run = plugins.command_provider(f"{sys.executable} {tmp_path}/ocr.py {{input_image}} {{output_md}} {{page_number}};{{model_name}}", "m1", str(tmp_path))
    pages = spark.createDataFrame([("s", 4, bytearray(b"scan"), False)], "source_id string, page_number int, content binary, blank boolean")
    row = plugins.read_scans(pages, run, "own").collect()[0]
    assert "read scan 4;m1" in row.markdown and (row.ocr_provider, row.ocr_model) == ("own", "m1")
    with pytest.raises(RuntimeError, match="ended with"):
        plugins.command_provider(f"{sys.executable} -c 1/0", "m", str(tmp_path))(b"", 1)
    probed = []
    ready = plugins.ReadyProviders({"own": run, "bad": run}, {"own": lambda: probed.append(1), "bad": lambda: 1 / 0})
    assert ready.get("auto", "own") is run and ready.get("own", "bad") is run and probed == [1]
    with pytest.raises(ZeroDivisionError):
        ready.get("bad", "own")
    with pytest.raises(KeyError):
        ready.get("none", "own")


def test_pages_of_documents(spark):
    def parse(content):
        if content == b"bad":
            raise ValueError("not a document")
        return [{"text": t, "has_images": "img" in t, "dark": len(t)} for t in content.decode().split("|")]

    files = spark.createDataFrame([("a", bytearray(b"one|img two")), ("b", bytearray(b"bad")), ("c", None)], "source_id string, content binary")
    got = {(r.source_id, r.page_number): r for r in plugins.scan_pages(files, parse).collect()}
    assert got["a", 2].has_images and got["a", 2].page_index == 1 and got["a", 1].dark == 3 and got["b", None].error == "not a document" and got["c", 1].text == ""
    assert plugins.scan_pages(files.where("false"), parse).count() == 0


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("c1", None, 3), ("c2", "S", None)], "chunk_id string, section string, page_start int")
    writers.write_records(rows, f"file://{tmp_path}/rows")
    assert {(r.chunk_id, r.section, r.page_start) for r in readers.read_chunks(spark, f"file://{tmp_path}/rows").collect()} == {("c1", None, 3), ("c2", "S", None)}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        writers.write_records(rows, f"file://{tmp_path}/rows")
    writers.write_originals(spark.createDataFrame([("s", "/x/a.pdf", bytearray(b"12"))], "source_id string, path string, content binary"), f"file://{tmp_path}/o", 2)
    kept = spark.read.parquet(f"file://{tmp_path}/o").collect()[0]
    assert (kept.name, bytes(kept.content), kept.length) == ("a.pdf", b"12", 2)
    t = writers.create_table(spark, f"file://{tmp_path}/t", rows.schema)
    assert t.read().count() == 0 and writers.create_table(spark, t.root, rows.schema).current() == 1
    with pytest.raises(ValueError, match="no columns"):
        writers.create_table(spark, t.root, spark.range(1).schema)


def test_appended_versions_are_read_as_upserts(spark, tmp_path):
    from folioforge.streaming import feed

    table = VersionedTable(spark, f"file://{tmp_path}/t")
    for batch, rows in enumerate([[("a", 1), ("b", 1)], [("b", 2), ("c", 2)]]):
        table.append(spark.createDataFrame(rows, "k string, v int").withColumn("batch_id", F.lit(batch)), "k")
    assert table.read().count() == 4
    assert {(r.k, r.v) for r in feed.newest(table.read(), "k").collect()} == {("a", 1), ("b", 2), ("c", 2)}
    feed.compact(table, "k")
    assert table.read().count() == 3 and len(table.parts()["rows"]) == 1


def test_zone_rules_have_a_release():
    from folioforge.functions import zones

    assert zones.version() and zones.version() != "system"


def test_service_health(spark):
    ok = ('{"status":"ok"}', '{"data":[{"id":"m"}]}', '{"model_alias":"m","modalities":{"vision":true}}')
    rows = [ok, ('{"status":"loading"}', *ok[1:]), (ok[0], '{"data":[]}', ok[2]), (*ok[:2], '{"model_alias":"n"}'), (*ok[:2], '{"model_alias":"m"}'), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert [r[0] for r in df.select(readers.service_health(F.col("a"), F.col("b"), F.col("c"), "m", True)).collect()] == [None, "not ready", "model is not loaded", "another model answers", "no vision", "not ready"]


def test_chapter_texts(spark):
    sources = spark.createDataFrame([("a", "one", "whole"), ("b", None, "whole b"), ("c", "lost", "whole c"), ("d", "", "whole d")], "source_id string, chapter string, document string")
    chapters = spark.createDataFrame([("a", "one", "chapter one"), ("a", "two", "x"), ("d", "", "y")], "source_id string, chapter string, text string")
    assert {r.source_id: r.text for r in chunking.chapter_texts(sources, chapters).collect()} == {"a": "chapter one", "b": "whole b", "c": "whole c", "d": "whole d"}


def test_saved_tables_go_when_they_are_released(spark):
    with runtime.released():
        df = runtime.save_table(spark.range(5), "x")
        path = df.inputFiles()[0]
        assert df.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE|does not exist"):
        spark.read.parquet(path.rsplit("/", 1)[0]).count()
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    with runtime.sized(spark, 50_000_000):
        assert spark.conf.get(name) == "50"
    assert spark.conf.get(name, None) is None


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class N:
                            @staticmethod
                            def isDefined():
                                return False

                        return N

                return S

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="shared|share"):
        runtime.shared_dir(Session)
