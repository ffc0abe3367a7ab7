"""The engine from files to context, and its settings."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from larkspur.config import Config, Watched, positive_int, updated
from larkspur.engine import Engine
from larkspur.operators import embed
from larkspur.streaming import index as files


def test_engine_from_files_to_context(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.md").write_text("# Engines\n" + "An engine turns fuel into motion and heat. " * 4 + "\n# Boats\n" + "A boat floats on water and needs an engine. " * 4)
    (source / "b.go").write_text("package main\n\nfunc Start() {\n" + "    run(fuel)\n" * 8 + "}\n")
    engine = Engine(spark, str(tmp_path / "store"), Config(top_k=5))
    assert engine.search("engine") == [] and engine.stats() == {"documents": 0, "chunks": 0, "vectors": 0}
    assert engine.index(str(source), "t")["added"] == 2
    assert engine.index(str(source), "t")["unchanged"] == 2 and engine.version() == 1
    hits = engine.search("boat water", tenant="t")
    assert hits[0]["rank"] == 1 and "floats" in hits[0]["text"] and engine.search("boat water", tenant="t") is hits
    assert engine.search("boat water", tenant="other") == []
    assert engine.context("engine", 30, tenant="t")["truncated"]
    (source / "b.go").unlink()
    (source / "a.md").write_text("# Engines\n" + "Only wind from now on, nothing else moves anything. " * 3)
    counts = engine.index(str(source), "t")
    assert (counts["updated"], counts["removed"]) == (1, 1)
    assert engine.search("boat", tenant="t", mode="fts") == []
    said = spark.createDataFrame([("remember that the harbour closes at nine in the evening", "user"), ("short", "user"), (None, "x")], "text string, source string")
    assert sorted(r["searchable"] for r in engine.remember(said, "t").collect()) == [False, True]
    assert engine.search("harbour", tenant="t", mode="fts")[0]["path"].startswith("memory://")
    assert engine.stats("t")["documents"] == 3
    engine.forget("t")
    assert engine.stats() == {"documents": 0, "chunks": 0, "vectors": 0}


def test_engine_reads_print_and_word_files_and_keeps_an_index(spark, tmp_path):
    from larkspur.plans.files import docx_bytes, pdf_bytes

    source = tmp_path / "src"
    source.mkdir()
    (source / "a.docx").write_bytes(docx_bytes("The lighthouse keeper writes letters every evening\nand posts them on Mondays, rain or shine"))
    (source / "b.pdf").write_bytes(pdf_bytes("Tides rise twice a day on this coast, and the keeper notes them all"))
    (source / "broken.docx").write_bytes(b"no archive")
    (source / "c.txt").write_text("Nothing about the sea in here, only hills and meadows and sheep on the hills.")
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.index(str(source), "t") == {"added": 3, "updated": 0, "removed": 0, "unchanged": 0, "failed": 1}
    assert engine.index(str(source), "t")["unchanged"] == 4
    plain = [(r["doc_id"], r["score"]) for r in engine.search("keeper letters", tenant="t", mode="fts")]
    assert len(plain) == 2 and engine.search("tides", mode="fts")[0]["path"].endswith("b.pdf")
    for how in ("heuristic", "bm25", "ensemble"):
        hits = engine.search("keeper letters", tenant="t", mode="fts", rerank=how)
        assert hits[0]["doc_id"] == plain[0][0] and [r["rank"] for r in hits] == [1, 2]
    with pytest.raises(ValueError):
        engine.search("x", rerank="none of these")
    shortest = lambda hits, query: hits.withColumn("score", -F.length("content").cast("double"))
    by_length = engine.search("keeper letters", tenant="t", mode="fts", rerank=shortest)
    assert [len(r["text"]) for r in by_length] == sorted(len(r["text"]) for r in by_length)
    words = Engine(spark, str(tmp_path / "words"), Config(min_bytes=10, max_tokens=4), splitters={"txt": lambda t: F.split(t, " ")})
    words.index(str(source), "t")
    of_text = "path like '%c.txt'"
    assert (engine.table("chunks").filter(of_text).count(), words.table("chunks").filter(of_text).count()) == (1, 2)
    engine.forget("t", next(r["path"] for r in engine.table("documents").collect() if r["path"].endswith("b.pdf")))
    assert engine.search("tides", mode="fts") == []


def test_folders_and_collections_keep_each_others_documents(spark, tmp_path):
    for folder, names in (("a", "one two three"), ("b", "four"), ("ab", "five")):
        (tmp_path / folder).mkdir()
        for n in names.split():
            (tmp_path / folder / f"{n}.txt").write_text(f"The {n} of folder {folder} is a text that is long enough to be kept as a chunk.")
    engine = Engine(spark, str(tmp_path / "store"))
    paths = lambda: sorted((r["collection"], r["path"].rsplit("/", 2)[1] + "/" + r["path"].rsplit("/", 1)[1]) for r in engine.table("documents").collect())
    assert engine.index(str(tmp_path / "a"), "t") == {"added": 3, "updated": 0, "removed": 0, "unchanged": 0, "failed": 0}
    assert engine.index(str(tmp_path / "b"), "t") == {"added": 1, "updated": 0, "removed": 0, "unchanged": 0, "failed": 0}
    assert engine.index(str(tmp_path / "ab"), "t", "other")["added"] == 1
    assert engine.index(str(tmp_path / "b"), "t", "other")["added"] == 1  # one path in two collections
    (tmp_path / "a" / "two.txt").unlink()
    assert engine.index(str(tmp_path / "a") + "/", "t") == {"added": 0, "updated": 0, "removed": 1, "unchanged": 2, "failed": 0}
    assert paths() == [("", "a/one.txt"), ("", "a/three.txt"), ("", "b/four.txt"), ("other", "ab/five.txt"), ("other", "b/four.txt")]
    assert len(engine.search("four", mode="fts")) == 2 and len(engine.search("four", mode="fts", collections=("other",))) == 1
    assert engine.search("two", mode="fts") == []
    engine.forget("t", next(r["path"] for r in engine.table("documents").collect() if r["path"].endswith("four.txt")))
    assert engine.search("four", mode="fts") == [] and len(paths()) == 3


def test_indexing_goes_on_where_it_was_stopped(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    for k in range(7):
        (tmp_path / "src" / f"f[{k}].txt").write_text(f"File number {k} has a text of its own that is long enough to be a chunk.")
    engine, read, stop = Engine(spark, str(tmp_path / "store")), [], [2]
    take, plain = Engine._take, files.read

    def stopping(self, *args, **more):
        if not stop[0]:
            raise KeyboardInterrupt
        stop[0] -= 1
        return take(self, *args, **more)

    monkeypatch.setattr(Engine, "_take", stopping)
    monkeypatch.setattr(files, "read", lambda spark, paths: read.extend(paths) or plain(spark, paths))
    with pytest.raises(KeyboardInterrupt):
        engine.index(str(tmp_path / "src"), "t", batch_files=2)
    assert engine.version() == 2 and engine.stats()["documents"] == 4
    stop[0] = 99
    again = Engine(spark, str(tmp_path / "store"))
    assert again.index(str(tmp_path / "src"), "t", batch_files=2) == {"added": 3, "updated": 0, "removed": 0, "unchanged": 4, "failed": 0}
    assert again.stats()["documents"] == 7 and len(read) == 9 and len(set(read)) == 7  # the batch that was stopped is read again, no other


def test_a_watched_folder_brings_changes_and_removals(spark, tmp_path):
    from larkspur.plans.files import docx_bytes

    source = tmp_path / "src"
    (source / "deep").mkdir(parents=True)
    (source / "a.md").write_text("# Gulls\n\nGulls cry over the harbour from early in the morning until the boats are in.")
    (source / "deep" / "b.docx").write_bytes(docx_bytes("The lighthouse keeper writes letters every evening and posts them on Mondays"))
    (source / "c.exe").write_text("no text " * 20)
    engine = Engine(spark, str(tmp_path / "store"))
    run = lambda: engine.watch(str(source), str(tmp_path / "state"), "t").awaitTermination()
    run()
    assert engine.stats("t")["documents"] == 2 and engine.search("keeper letters", mode="fts")[0]["path"].endswith("b.docx")
    run()
    assert engine.version() == 1  # nothing has changed
    (source / "deep" / "b.docx").unlink()
    (source / "a.md").write_text("# Terns\n\nTerns have taken the place of all others on the pier this summer, and they stay.")
    (source / "d.txt").write_text("A third file tells of ropes and sails, which are sold behind the harbour.")
    run()
    assert engine.stats("t")["documents"] == 2 and engine.version() == 2
    assert engine.search("keeper", mode="fts") == engine.search("gulls", mode="fts") == [] and len(engine.search("terns ropes", mode="fts")) == 2
    assert {r["path"].rsplit("/", 1)[1] for r in engine.table("vectors").select("path").distinct().collect()} == {"a.md", "d.txt"}
    # a batch whose change is written already does nothing when it runs again
    log = engine.kept.log.entries()
    assert max(e["batch"] for e in log.values()) == 1
    assert engine.index(str(source), "t")["unchanged"] == 2  # the same files by another way


def test_a_search_after_a_change_reads_postings_and_no_texts(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    say = lambda *texts: engine.remember(spark.createDataFrame([(t, "user") for t in texts], "text string, source string"), "t")
    say("remember that the harbour closes at nine in the evening", "the lighthouse is painted in red and white stripes this year")
    say("a second note about the harbour, and about the boats in it")
    index = engine.text_index
    assert index.state() == engine.version() == 2 and index.totals()["n"] == 3
    read = {f.rsplit("/", 2)[1] for f in index.as_it_is().top(["harbour"], 5).inputFiles()}
    assert {"postings"} <= read <= {"postings", "blocks", "corrections", "gone"}
    assert len(engine.search("harbour", mode="fts")) == 2
    later = Engine(spark, str(tmp_path / "store"))
    later.build_index = lambda: None  # a writer that stops before its index is written
    later.remember(spark.createDataFrame([("the harbour master retires in autumn, after thirty years of service", "x")], "text string, source string"), "t")
    assert index.state() == 2 and len(engine.search("harbour", mode="fts")) == 3 and index.state() == 3
    engine.kept.clear()
    assert engine.search("harbour", mode="fts") == [] and index.totals()["n"] == 0


def test_searches_use_an_index_of_vectors_that_follows_the_changes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), Config(vector_index_from=3))
    say = lambda tenant, *texts: engine.remember(spark.createDataFrame([(t, "user") for t in texts], "text string, source string"), tenant)
    say("t", "remember that the harbour closes at nine in the evening", "the lighthouse is painted in red and white stripes this year")
    assert engine.index_vectors() is None
    say("u", "a second note about the harbour, and about the boats in it", "another person's note about boats and about ropes and sails")
    assert engine.index_vectors() is not None and engine.vector_index.count() == 4
    say("t", "boats and ropes and sails are sold behind the old harbour")
    assert engine.vector_index.kept.state() == engine.version() == 3 and engine.vector_index.count() == 5
    for tenant, n in (("t", 3), ("u", 2), (None, 5)):
        hits = engine.search("boats and ropes and sails", mode="vector", tenant=tenant)
        assert len(hits) == n and "boats" in hits[0]["text"]
    engine.forget("u")
    assert len(engine.search("boats and ropes and sails", mode="vector")) == 3 and engine.vector_index.count() == 3
    assert len(engine.search("boats and ropes and sails", mode="vector", path_prefix="memory://", tenant="t")) == 3


def test_config():
    assert updated(Config(), {"top_k": 3}).top_k == 3
    for bad in ({"top_k": 0}, {"mode": "x"}, {"nothing": 1}):
        with pytest.raises(ValueError):
            updated(Config(), bad)


def test_settings_are_read_again(tmp_path):
    file, seen = tmp_path / "settings.json", []
    watched = Watched(str(file), changed=seen.append)
    assert watched.config == Config() and watched.error is not None
    file.write_text('{"top_k": 4}')
    assert watched.reload() and watched.config.top_k == 4 and not watched.reload() and len(seen) == 1
    file.write_text('{"top_k": 0, "mode": "fts"}')
    assert not watched.reload() and watched.config.top_k == 4 and "top_k" in str(watched.error)
    assert [positive_int(x, 7) for x in ("3", 5, "0", "-2", "x", None, "")] == [3, 5, 7, 7, 7, 7, 7]


class _Service(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        self.send_response(200)
        self.end_headers()

    def do_POST(self):
        text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
        _Service.asked.append(text)
        if text == "slow":
            time.sleep(3)
        ok = text != "broken" and not (text == "once" and _Service.asked.count("once") == 1)
        self.send_response(200 if ok else 500)
        self.end_headers()
        try:
            self.wfile.write(json.dumps({"embedding": [float(len(text)), 1.0]}).encode() if ok else b"")
        except OSError:
            pass  # the one that asked has gone

    def log_message(self, *_):
        pass


def test_an_embedding_service_in_batches_with_errors_and_timeouts(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    provider = embed.HttpProvider(f"http://127.0.0.1:{server.server_port}", "m", 2, timeout=1, retries=1, pause=0.01)
    try:
        assert provider.healthy() and not embed.HttpProvider("http://127.0.0.1:9", "m", 2, timeout=1).healthy()
        rows = [(0, "aa"), (1, "broken"), (2, "once"), (3, None), (4, "slow"), (5, "four")]
        got = {r["k"]: r for r in embed.embed_with(spark.createDataFrame(rows, "k long, text string").coalesce(1), "text", provider, errors="why").collect()}
        assert got[0]["embedding"] == [2.0, 1.0] and got[2]["embedding"] == [4.0, 1.0] and got[5]["embedding"] == [4.0, 1.0]
        assert got[1]["embedding"] is got[4]["embedding"] is got[3]["embedding"] is None
        assert "500" in got[1]["why"] and "time" in got[4]["why"].lower() and got[0]["why"] is got[3]["why"] is None
        with pytest.raises(Exception, match="500"):
            embed.embed_with(spark.createDataFrame([(1, "broken")], "k long, text string"), "text", provider).collect()
        assert embed.pick([embed.HttpProvider("http://127.0.0.1:9", "m", 2, timeout=1), provider]) is provider
    finally:
        server.shutdown()


class _Batches(BaseHTTPRequestHandler):
    sizes: list = []
    keys: set = set()

    def do_GET(self):
        self.send_response(200 if self.path == "/v1/models" else 404)
        self.end_headers()

    def do_POST(self):
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        _Batches.sizes.append(len(texts))
        _Batches.keys.add(self.headers.get("Authorization"))
        ok = "broken" not in texts
        self.send_response(200 if ok else 500)
        self.end_headers()
        data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(texts)]
        self.wfile.write(json.dumps({"data": data[::-1]}).encode() if ok else b"")

    def log_message(self, *_):
        pass


def test_an_embedding_service_that_takes_many_texts_a_request(spark, monkeypatch):
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Batches)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("EMBEDDING_KEY", "k1")
    provider = embed.BatchProvider(f"http://127.0.0.1:{server.server_port}", "m", 2, per_request=5, timeout=5, retries=0, key_from="EMBEDDING_KEY")
    try:
        assert provider.healthy() and provider.embed([]) == []
        assert provider.embed(["a" * i for i in range(12)]) == [[float(i), 1.0] for i in range(12)] and _Batches.keys == {"Bearer k1"}
        assert sorted(_Batches.sizes) == [2, 5, 5]
        rows = spark.createDataFrame([(i, "broken" if i == 7 else "x" * i) for i in range(12)], "k long, text string").coalesce(1)
        got = {r["k"]: r for r in embed.embed_with(rows, "text", provider, errors="why").collect()}
        assert "500" in got[7]["why"] and all(got[i]["embedding"] == [float(i), 1.0] for i in range(12) if i != 7)
        with pytest.raises(ValueError):
            embed.BatchProvider(f"http://127.0.0.1:{server.server_port}", "m", 3, retries=0).embed(["a"])
    finally:
        server.shutdown()
