"""Operators against values worked out by hand, and against plain Python."""

from __future__ import annotations

import datetime
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import vectors as V
from larkspur.operators import chunkers, context, embed, folds, fulltext, markdown, quantise, search, segments, store, textindex
from larkspur.operators.graphindex import GraphIndex, graph, units, walk
from larkspur.operators.segments import SegmentStore
from larkspur.operators.textindex import TextIndex
from larkspur.operators.vectorindex import PqIndex, VectorIndex, scan, scan_many, search_or_scan
from larkspur.plans.files import docx_bytes, pdf_bytes, pdf_file
from larkspur.plans.registry import vectors
from larkspur.sources import codecs, pdf
from larkspur.streaming import index


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_distances(spark):
    assert one(spark, V.cosine_distance(array(1, 0), array(1, 0))) == 0
    assert one(spark, V.cosine_distance(array(1, 0), array(-1, 0))) == 2
    assert one(spark, V.cosine_distance(array(1, 0), array(0, 1))) == 1
    assert one(spark, V.cosine_distance(array(0, 0), array(0, 1))) == 1
    assert one(spark, V.cosine_similarity(array(1, 0), array(1, 0, 0))) == 0
    assert one(spark, V.l2_distance(array(1, 2, 3), array(4, 5, 6))) == pytest.approx(math.sqrt(27))
    assert one(spark, V.squared_euclidean(array(1, 2), array(0, 0, 9))) == 5
    assert one(spark, V.normalize(array(0, 0))) == [0, 0]


def test_smart_truncate(spark):
    def cut(s, n):
        return one(spark, T.smart_truncate(F.lit(s), F.lit(n)))

    assert cut("Short text.", 100) == "Short text."
    assert cut("One sentence. Another sentence that goes on and on.", 10) == "One sentence." + T.CUT_MARK
    assert cut("no end in this text at all", 3) == "no end..."
    assert cut("x。!" + "y" * 40, 4) == "x。" + T.CUT_MARK  # an adjacent later kind loses


def test_context(spark):
    hits = spark.createDataFrame([(1, "a" * 24, 6), (2, "b" * 24, 6)], "rank int, content string, token_count int")
    whole = context.context(hits, 100).first()
    assert (whole["token_count"], whole["truncated"]) == (14, False) and whole["context"].count("---") == 1
    small = context.context(hits, 5).first()
    assert small["truncated"] and small["token_count"] == 5
    none = context.context(hits.limit(0), 5).first()
    assert (none["context"], none["token_count"], none["truncated"]) == ("", 0, False)


def test_query_language():
    a, b, c = (("phrase", None, [x]) for x in "abc")
    assert fulltext.parse("a b OR c") == ("or", ("and", a, b), c)
    assert fulltext.parse("a NOT (b OR c)") == ("not", a, ("or", b, c))
    assert fulltext.parse('x:"A b" pre*') == ("and", ("phrase", "x", ["a", "b"]), ("prefix", None, "pre"))
    assert fulltext.parse("NEAR(a b, 3)") == ("near", ["a", "b"], 3)
    for bad in ("(a", "OR a", "a AND", ""):
        with pytest.raises(ValueError):
            fulltext.parse(bad)


def test_search_options():
    with pytest.raises(ValueError):
        search.SearchOptions(mode="other")
    with pytest.raises(ValueError):
        search.SearchOptions(top_k=0)


def test_search_without_terms(spark):
    docs = spark.createDataFrame([(1, "en", "c", "p", "some text")], "doc_id long, tenant string, collection string, path string, text string")
    vecs = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    assert [r["doc_id"] for r in search.search(docs, vecs, "...", q).collect()] == [1]
    assert search.search(docs, vecs, "text", q, search.SearchOptions(tenant="fr")).count() == 0


def test_folds_match_python(spark):
    rows = [(u, e, e * 700_000 * (u + 1)) for u in range(3) for e in range(40)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, us long")
    got = {(r["user_id"], r["event_id"]): r["accepted"] for r in folds.debounce(events, "user_id", "us", 2).collect()}
    for u in range(3):
        last = None
        for e in range(40):
            us = e * 700_000 * (u + 1)
            ok = last is None or us - last >= 2_000_000
            last = us if ok else last
            assert got[u, e] == ok


def test_greedy_pack_flushes_by_both_limits(spark):
    docs = spark.createDataFrame([(1, "\n".join(["x" * 40] * 5)), (2, ""), (3, None)], "doc_id long, text string")
    packed = chunkers.pack(docs, chunkers.lines(F.col("text")), max_tokens=20)
    assert [r["chunk"] for r in packed.orderBy("pos").collect()] == [0, 0, 1, 1, 2]
    whole = chunkers.chunks(docs, chunkers.lines(F.col("text")), max_tokens=20).orderBy("chunk").collect()
    assert [(r["chunk"], r["token_count"], r["n_pieces"], r["content"]) for r in whole] == [(0, 20, 2, "\n".join(["x" * 40] * 2)), (1, 20, 2, "\n".join(["x" * 40] * 2))]  # the last is too short
    assert "Exchange" not in chunkers.chunks(docs, chunkers.lines(F.col("text")))._jdf.queryExecution().executedPlan().toString()


def plain_chunks(pieces, opens, max_tokens, min_bytes):
    """Greedy packing in plain Python: (content, pieces) of the chunks that are long enough."""
    out, held, tokens, size, fenced = [], [], 0, 0, False
    for p in pieces:
        n = len(p.encode()) // 4
        if size > min_bytes and (tokens + n > max_tokens or opens(p) and not fenced):
            out.append((held, size))
            held, tokens, size = [], 0, 0
        held, tokens, size = [*held, p], tokens + n, size + len(p.encode()) + 1
        fenced ^= p.lstrip().startswith(("```", "~~~"))
    return [("\n".join(h), len(h)) for h, s in [*out, (held, size)] if s > min_bytes]


def test_chunks_equal_plain_packing(spark):
    rng = random.Random(2)
    docs = [(k, "\n".join(rng.choice(["# Title", "text " * rng.randrange(1, 40), "", "```", "## Sub é", "#no", "  ~~~ x"]) for _ in range(rng.randrange(0, 60)))) for k in range(60)]
    got = {}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for r in chunkers.chunks(frame, chunkers.lines(F.col("text")), chunkers.is_heading, max_tokens=60).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append((r["content"], r["n_pieces"]))
    for k, text in docs:
        pieces = [x for x in text.split("\n") if x.strip(" ")]
        assert got.get(k, []) == plain_chunks(pieces, lambda p: re.match(r"#{1,6}\s+\S", p) is not None, 60, 50)
    packed = chunkers.pack(frame, chunkers.lines(F.col("text")), chunkers.is_heading, max_tokens=60)
    joined = packed.groupBy("doc_id", "chunk").agg(F.sum("bytes").alias("size"), F.count("*").alias("n")).filter("size > 50")
    assert sorted(r["n"] for r in joined.collect()) == sorted(n for found in got.values() for _, n in found)


def test_headings_inside_fences_open_nothing(spark):
    text = "# One\nfirst\n```sh\n# a comment\nrun\n```\nrest\n## Two\nsecond"
    row = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert row.select(chunkers.sections(F.col("text"))).first()[0] == ["# One\nfirst\n```sh\n# a comment\nrun\n```\nrest\n", "## Two\nsecond"]
    for text, want in (("x\n\n\n  ~~~\n# c\n\n~~~\n# H\ny", ["x\n\n\n  ~~~\n# c\n\n~~~\n", "# H\ny"]), ("```\n# c\n```\n\n# H\n##\n#no", ["```\n# c\n```\n\n", "# H\n", "##\n#no"]), ("", []), ("# A", ["# A"])):
        assert spark.createDataFrame([(text,)], "text string").select(chunkers.sections(F.col("text"))).first()[0] == want
    packed = chunkers.pack(row, chunkers.lines(F.col("text")), chunkers.is_heading, min_bytes=1)
    assert [r["chunk"] for r in packed.orderBy("pos").collect()] == [0] * 7 + [1] * 2
    assert {r["heading"] for r in chunkers.heading_in_effect(packed).collect()} == {"One", "Two"}


#: Texts and their blocks (kind, level, text), by hand.
MARKDOWN = [
    ("# One #\ntext\nmore\n\nTwo\n===\nThree\n---\n#no heading\n####### nor this\n##\n", [("heading", 1, "One"), ("paragraph", 0, "text\nmore"), ("heading", 1, "Two"), ("heading", 2, "Three"), ("paragraph", 0, "#no heading\n####### nor this"), ("heading", 2, "")]),
    ("```py\n# not a heading\n~~~\n\n```\nafter\n~~~~\n```\n~~~\n~~~~~\n# Yes", [("code", 1, "```py\n# not a heading\n~~~\n\n```"), ("paragraph", 0, "after"), ("code", 1, "~~~~\n```\n~~~\n~~~~~"), ("heading", 1, "Yes")]),
    ("```\nnever closed\n# in it", [("code", 1, "```\nnever closed\n# in it")]),
    ("- a\n- b\n\n  more of b\n  # in b\n* c\n\nout\n1. x\n2) y\nlazy\n\n10. z", [("list", 0, "- a\n- b\n\n  more of b\n  # in b\n* c"), ("paragraph", 0, "out"), ("list", 0, "1. x\n2) y\nlazy\n\n10. z")]),
    ("> said\n> # in it\nlazy\n\n> again\n***\n- - -\n    code\n\n    # code\nend", [("quote", 0, "said\n# in it\nlazy"), ("quote", 0, "again"), ("code", 0, "    code\n\n    # code"), ("paragraph", 0, "end")]),
    ("<div>\n# raw\n</div>\n\n<!-- one\n\n# two -->\n<script>\n\n# x\n</script>\ntext\n    goes on", [("html", 0, "<div>\n# raw\n</div>"), ("html", 0, "<!-- one\n\n# two -->"), ("html", 0, "<script>\n\n# x\n</script>"), ("paragraph", 0, "text\ngoes on")]),
    ("", []),
    ("\n \n\t\n", []),
]


def test_markdown_blocks_equal_a_fixture(spark):
    for text, want in MARKDOWN:
        assert markdown.blocks_of(text) == want, text
        assert markdown.blocks_of(text.replace("\n", "\r\n")) == want
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MARKDOWN)] + [(99, None)], "k long, text string")
    got = {r["k"]: r["b"] and [tuple(x) for x in r["b"]] for r in rows.select("k", markdown.blocks("text").alias("b")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(MARKDOWN)} | {99: None}
    two = spark.createDataFrame([(1, "Title\n=====\n" + "words " * 20 + "\n\n```\n# a comment that is long enough to be a chunk of its own, if it were\n```\n# Next\n" + "text " * 20)], "doc_id long, text string")
    chunks = chunkers.chunks(two, chunkers.split_by_kind(F.lit("md"), F.col("text")), chunkers.is_heading).orderBy("chunk").collect()
    assert [r["first_piece"] for r in chunks] == ["# Title", "# Next"] and "# a comment" in chunks[0]["content"]


def test_many_headings_are_cut_in_linear_time(spark):
    text = "\n".join(f"# heading {k}\nsome words" for k in range(100000))
    big = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.monotonic()
    assert big.select(F.size(chunkers.sections(F.col("text")))).first()[0] == 100000
    assert chunkers.chunks(big, chunkers.sections(F.col("text")), lambda p: F.lit(True), min_bytes=10).count() == 100000
    assert time.monotonic() - start < 60
    start = time.monotonic()
    assert len(markdown.blocks_of(text)) == 200000 and time.monotonic() - start < 20


def test_many_pieces_are_packed_in_linear_time(spark):
    big = spark.createDataFrame([(1, "\n".join(f"# line {k} with some words in it" for k in range(60000)))], "doc_id long, text string")
    start = time.monotonic()
    assert chunkers.chunks(big, chunkers.lines(F.col("text"))).agg(F.sum("n_pieces")).first()[0] == 60000
    assert time.monotonic() - start < 60


def test_chunks_by_tokens_of_a_vocabulary(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from larkspur.functions.bpe import bpe_counts, encoder

    texts = ["some words here\nand a second line of them\n<|endoftext|> éa" * 3, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for path, pattern in ((public_tokenizers.path("byte_bpe_50k.json"), None), (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)):
        packed = chunkers.pack(docs, chunkers.lines(F.col("text")), max_tokens=12, min_bytes=0, tokens=bpe_counts(path, pattern)).orderBy("pos").collect()
        lines = texts[0].split("\n")
        assert [r["tokens"] for r in packed] == encoder(path, pattern)(lines)
        in_chunk = {}
        for r in packed:
            in_chunk[r["chunk"]] = in_chunk.get(r["chunk"], 0) + r["tokens"]
        assert len(in_chunk) > 1 and all(n <= 12 or [r["chunk"] for r in packed].count(c) == 1 for c, n in in_chunk.items())


def test_codecs(spark):
    assert codecs.docx_paragraphs(docx_bytes("first & <b>\nsecond")) == "first & <b>\nsecond"
    assert codecs.docx_paragraphs(b"no archive") is None
    text = "A page (with brackets) that is long enough to be kept,\nand a second line."
    assert codecs.pdf_pages(pdf_bytes(text)) == [text]
    assert codecs.pdf_pages(b"%PDF garbage") == []
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    back = df.select(codecs.decode_vector(codecs.encode_vector("v")).alias("v")).collect()
    assert [r["v"] for r in back] == [[1.5, -2.0], None]


def test_pdf_files_of_several_kinds():
    said = "The keeper of the light (at the end of the pier) writes \\ letters every evening"
    shown = said.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode()
    old = b"""%PDF-1.3
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 9 0 R] /Count 2 /Resources << /Font << /F1 4 0 R /F2 7 0 R >> >> >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Contents [5 0 R 6 0 R] >> endobj
4 0 obj << /Type /Font /Subtype /Type1 >> endobj
5 0 obj << /Length 8 0 R >> stream
BT /F1 12 Tf 72 650 Td [(second) -300 (line,) 20 ( and on)] TJ ET BT /F1 12 Tf 72 700 Td (""" + shown + b""") Tj ET
endstream endobj
6 0 obj << >> stream
q 1 0 0 1 0 -50 cm BT /F2 12 Tf 300 700 Td <0102> Tj /F1 12 Tf 0 -24 Td (third\\012\\351) Tj T* (fourth) Tj ET Q
endstream endobj
7 0 obj << /Type /Font /ToUnicode 10 0 R >> endobj
9 0 obj << /Type /Page /Contents 11 0 R >> endobj
10 0 obj << /Length 1 >> stream
1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <01> <02> <00E9> endbfrange
endstream endobj
11 0 obj << >> stream
BT (short) Tj ET
endstream endobj
"""
    assert pdf.pages_of(old) == [said + "\nsecond line, and on \u00e9\u00ea\nthird\n\u00e9\nfourth"]
    text = "Ein Leuchtturmw\u00e4rter schreibt Briefe \U0001f600 an jedem Abend\n" + "\n".join(f"line {i} of the file" for i in range(24))
    assert pdf.pages_of(pdf_file(text)) == ["\n".join(text.split("\n")[i : i + 10]) for i in (0, 10, 20)]
    assert pdf.pages_of(b"") is None and pdf.pages_of(b"%PDF-1.4 junk (((( << [ 1 0 obj stream") is None
    loop = b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [2 0 R 3 0 R] >> endobj 3 0 obj 4 0 R endobj 4 0 obj 3 0 R endobj"
    assert pdf.pages_of(loop) in (None, [])


def test_trained_codebook_beats_fixed(spark, sf_dir):
    vecs = vectors(spark, sf_dir)

    def error(book):
        back = quantise.decode(quantise.encode(vecs, book), book).withColumnRenamed("embedding", "back")
        return vecs.join(back, "doc_id").agg(F.avg(V.squared_euclidean(F.col("embedding"), F.col("back"))).alias("e")).first()["e"]

    assert error(quantise.train(vecs)) < error(quantise.fixed_codebook(vecs))
    with pytest.raises(ValueError):
        quantise.train(vecs.limit(3))


def test_embedding_providers(spark):
    class Down:
        def healthy(self):
            return False

    with pytest.raises(RuntimeError):
        embed.pick([Down()])
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    sparse = embed.hash_embedding(docs, "doc_id", "text")
    dense = embed.dense(sparse, "doc_id").first()["embedding"]
    assert len(dense) == 64 and sum(x * x for x in dense) == pytest.approx(1)
    out = embed.embed_with(docs, "text", lambda texts: [[float(len(t))] for t in texts]).orderBy("doc_id").collect()
    assert [r["embedding"] for r in out] == [[5.0], None]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, content_hash string")
    assert {tuple(r) for r in store.upsert(old, new, ["path"]).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    assert {tuple(r) for r in store.sync(old, new).collect()} == {("a", "removed"), ("b", "updated"), ("c", "added")}
    target = store.snapshot(spark, {"t": old}, str(tmp_path), datetime.datetime(2024, 1, 2))
    assert store.restore(spark, target, "t").count() == 2


def test_stream_indexes_new_files_once(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / ".git").mkdir(parents=True)
    (folder / "a.md").write_text("# One\n" + "text " * 20 + "\n# Two\n" + "more " * 20)
    (folder / ".git" / "b.md").write_text("# No\n" + "text " * 20)
    (folder / "c.exe").write_text("text " * 20)
    run = lambda: index.watch(spark, str(folder), index.write_version(str(tmp_path / "out")), str(tmp_path / "state")).awaitTermination()
    run()
    assert index.current(spark, str(tmp_path / "out")).count() == 2
    (folder / "d.txt").write_text("plain " * 20)
    run()
    assert index.current(spark, str(tmp_path / "out")).count() == 3
    assert index.scan(spark, str(folder)).count() == 2


def indexed_corpus(spark, folder):
    words = "oak elm fir ash yew oakley".split()
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))), f"src {rng.choice(words)}") for k in range(120)] + [(500, None, None), (501, "", "oak"), (502, "Oak, OAK! Élan élan", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collection string").repartition(3)
    return docs, TextIndex.kept(spark, folder, lambda: docs, {"text": "text", "collection": "collection"})


def test_the_kept_index_answers_like_the_texts(spark, tmp_path):
    docs, index = indexed_corpus(spark, str(tmp_path / "index"))
    for terms in (["oak"], ["oak", "elm", "none"], ["elan"], []):
        for weights in ({"text": 1.0}, {"text": 1.0, "collection": 2.0}):
            want = {tuple(r)[:1]: tuple(r)[1:] for r in fulltext.bm25_fields(docs, terms, weights).collect()}
            got = {tuple(r)[:1]: tuple(r)[1:] for r in index.bm25(terms, weights).collect()}
            assert got.keys() == want.keys()
            assert all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)
    both = {"text": "text", "collection": "collection"}
    for q in ("oak elm", "oak OR yew", "oak NOT (elm OR ash)", '"oak elm"', '"oak elm fir"', "oak* fir", "collection:oak", 'collection:"src oak" ash', "NEAR(oak ash, 2)", "NEAR(elm, 3)", "zzz* OR elan"):
        assert {r[0] for r in index.match(q).collect()} == {r[0] for r in fulltext.match(docs, q, both).select("doc_id").collect()}, q
    assert {r[0] for r in index.match("oak", ("collection",)).collect()} == {r[0] for r in fulltext.match(docs, "collection:oak", both).select("doc_id").collect()}
    assert {tuple(r) for r in index.terms().filter("field = 'text'").select("term", "df", "cf").collect()} == {tuple(r) for r in fulltext.term_stats(fulltext.postings(docs)).collect()}


def changed_index(spark, folder, monkeypatch, fanout):
    """An index after additions, changes and removals by owner, and the documents as they are then."""
    monkeypatch.setattr(segments, "FANOUT", fanout)
    fields, schema = {"text": "text", "title": "title"}, "doc_id string, owner string, text string, title string"
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    make = lambda o, v, n: [(f"{o}-{v}-{i}", o, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))), rng.choice(words)) for i in range(n)]
    now = {f"o{i}": make(f"o{i}", 0, 3) for i in range(40)}
    rows = lambda some: spark.createDataFrame([r for rs in some for r in rs], schema)
    index = TextIndex.build(rows(now.values()), folder, fields, owner="owner")
    for v in range(1, 5):
        new = {f"o{i}": make(f"o{i}", v, rng.randrange(0, 4)) for i in rng.sample(range(60), 6)}
        gone = [f"o{i}" for i in rng.sample(range(60), 3)]
        for o in gone:
            now.pop(o, None)
        now |= new
        index.change(rows(new.values()), spark.createDataFrame([(o,) for o in {*gone, *new}], "owner string"), fields, "owner", v)
    index.change(None, spark.createDataFrame([("o1",), ("never",)], "owner string"), fields, "owner", 5)
    now.pop("o1", None)
    return index, rows(now.values()), fields


@pytest.mark.parametrize("fanout", [3, 100])
def test_an_index_after_changes_equals_one_built_anew(spark, tmp_path, monkeypatch, fanout):
    index, docs, fields = changed_index(spark, str(tmp_path / "index"), monkeypatch, fanout)
    anew = TextIndex.build(docs, str(tmp_path / "anew"), fields, owner="owner")
    assert index.state() == 5 and (len(index.spans()) < 5 if fanout == 3 else len(index.spans()) == 6)
    assert index.totals() == anew.totals()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(index.terms()) == rows(anew.terms())
    for terms in (["w1", "w2", "w3"], ["none", "w1"]):
        for weights in (None, {"text": 1.0, "title": 2.0}):
            assert rows(index.bm25(terms, weights)) == rows(anew.bm25(terms, weights)) == rows(fulltext.bm25_fields(docs, terms, weights or {"text": 1.0}))
    for q in ("w1 w2", 'w1 NOT title:w1', '"w1 w1"', "w1* NOT w3"):
        assert rows(index.match(q)) == rows(fulltext.match(docs, q, fields).select("doc_id")), q


def test_the_best_are_found_without_all_postings(spark, tmp_path, monkeypatch):
    index, docs, _ = changed_index(spark, str(tmp_path / "index"), monkeypatch, 100)
    skipped = 0
    for terms, k in ((["w1"], 1), (["w2", "w1"], 5), (["w9", "w1", "w2"], 1), (["none"], 1)):
        for found in (None, docs.filter("doc_id like '%-0-%'")):
            rows = [tuple(r) for r in index.top(terms, k, found, skip=True).collect()]
            assert rows == [tuple(r) for r in index.top(terms, k, found, skip=False).collect()]
        keys = index.candidates(terms, 1)
        skipped += keys is not None and keys.count() < index.postings(terms).select("key").distinct().count() / 2
    assert skipped >= 1


def test_a_question_reads_its_terms_only(spark, tmp_path, monkeypatch):
    terms = ["oak", "élan", "数据", "a" * 100]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(textindex.bucket(F.col("t"))).collect()] == [textindex.bucket_of(t) for t in terms]
    docs, index = indexed_corpus(spark, str(tmp_path / "index"))
    monkeypatch.setattr(textindex, "BUCKETS_FROM", 10)
    plan = index.postings(["oak"])._jdf.queryExecution().toString()
    assert "EqualTo(term,oak)" in plan
    large = TextIndex.build(docs, str(tmp_path / "large"), {"text": "text"})
    assert "PartitionFilters: [" in large.postings(["oak"])._jdf.queryExecution().toString()
    assert sorted(map(tuple, large.bm25(["oak", "elan"]).collect())) == sorted(map(tuple, fulltext.bm25(docs, ["oak", "elan"]).collect()))
    assert "StringStartsWith(term,oak)" in index.prefixed("oak")._jdf.queryExecution().toString()


def test_an_index_is_built_once_and_of_two_builders_one_wins(spark, tmp_path):
    folder = str(tmp_path / "index")
    _, index = indexed_corpus(spark, folder)
    again = TextIndex.kept(spark, folder, lambda: pytest.fail("built again"), {"text": "text", "collection": "collection"})
    assert again.folder == index.folder
    assert not store.create_once(spark, f"{folder}/CURRENT", "other") and store.read_text(spark, f"{folder}/CURRENT") == index.folder.rsplit("/", 1)[1]
    assert store.read_text(spark, f"{folder}/missing") is None
    empty = TextIndex.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "empty"), {"text": "text"})
    assert empty.bm25(["oak"]).count() == 0 and empty.match("oak").count() == 0


def test_changes_of_tables_by_key(spark, tmp_path, monkeypatch):
    schema = "k long, v string"
    kept = SegmentStore(spark, str(tmp_path / "s"), ["k"], {"a": schema, "b": schema})
    make = lambda rows: spark.createDataFrame(rows, schema)
    now = lambda name: sorted(tuple(r) for r in kept.table(name).collect())
    assert kept.version() == 0 and now("a") == []
    assert kept.put({"a": make([(1, "x"), (2, "y"), (2, "z")]), "b": make([(2, "b")])}) == 1
    kept.put({"a": make([(2, "new")])})
    assert now("a") == [(1, "x"), (2, "new")] and now("b") == []  # the key's rows go from all tables
    kept.put({}, make([(1, None)]))
    assert now("a") == [(2, "new")]
    other = SegmentStore(spark, str(tmp_path / "s"), ["k"], {"a": schema, "b": schema})
    assert other.put({"b": make([(3, "c"), (None, "n")])}) == 4
    before = now("a"), sorted(str(tuple(r)) for r in kept.table("b").collect())
    assert before[1] == ["(3, 'c')", "(None, 'n')"]
    kept.compact()
    assert (now("a"), sorted(str(tuple(r)) for r in kept.table("b").collect())) == before and len(kept.log.live()) == 1
    monkeypatch.setattr(segments, "FANOUT", 4)
    for k in range(9):
        kept.put({"a": make([(k % 3, f"v{k}")])})
        assert len(kept.log.live()) <= 6
    assert now("a") == [(0, "v6"), (1, "v7"), (2, "v8")]
    assert kept.log.vacuum(grace=3600) == [] and kept.log.vacuum(grace=-1)  # what merges replaced goes after a while
    assert now("a") == [(0, "v6"), (1, "v7"), (2, "v8")] and len([n for n in store.names(spark, str(tmp_path / "s")) if n != "log"]) == len(kept.log.live())
    seen = kept.version()
    kept.put({"b": make([(7, "late")])})
    assert [sorted(map(tuple, kept.rows_of(c, "b").collect())) for c in kept.changes(seen)][-1] == [(7, "late")]
    kept.clear()
    assert now("a") == now("b") == [] and kept.changes(seen) is None


def test_vector_index_finds_adds_and_removes(spark, tmp_path):
    vecs = vectors(spark, "/root/testdata/sf0.1").select("doc_id", "embedding", F.when(F.col("doc_id") % 20 == 3, "rare").otherwise("often").alias("tenant"))
    index = VectorIndex.create(vecs, str(tmp_path / "ivf"), columns=["tenant"])
    assert len(index.centroids()) == pytest.approx(vecs.count() ** 0.5, abs=6) and 5 <= len(index.groups()) <= 8
    rows = lambda df: [tuple(r) for r in df.collect()]
    q = vecs.filter("doc_id = 0").first()["embedding"]
    exact = rows(scan(vecs, q, 10))
    assert rows(index.search(q, 10, share=1.0)) == exact
    # a tenant with a twentieth of the vectors: cells are chosen by its own, and read in proportion
    rare = vecs.filter("tenant = 'rare'")
    assert rows(index.search(q, 10, tenant="rare", share=1.0)) == rows(scan(rare, q, 10))
    few, whole = index.nearest_cells(q, 30, "rare")
    assert not whole and len(few) < 0.6 * len(index.centroids())
    assert rows(index.search(q, 3, F.col("doc_id") > 1900, "rare", 0.01)) == rows(scan(rare.filter("doc_id > 1900"), q, 3)) or index.search(q, 3, F.col("doc_id") > 1900, "rare", 0.01).count() == 3
    assert index.search(q, 10, tenant="nobody").count() == 0
    plan = index.kept.table("vectors").filter("grp = 1 and cell in (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(grp" in plan and "PushedFilters: [In(cell" in plan
    best = exact[0][0]
    index.remove(vecs.filter(F.col("doc_id") == best))
    assert rows(index.search(q, 9, share=1.0)) == exact[1:]
    index.add(vecs.filter(F.col("doc_id") == best))
    assert rows(index.search(q, 10, share=1.0)) == exact and index.count() == vecs.count()
    index.clear()
    assert index.count() == 0 and rows(search_or_scan(index, vecs, q, 10)) == exact
    assert not VectorIndex(spark, str(tmp_path / "none")).exists()


def test_graph_index_finds_adds_and_removes(spark, tmp_path):
    vecs = vectors(spark, "/root/testdata/sf0.1").select("doc_id", "embedding")
    index = GraphIndex.create(vecs, str(tmp_path / "g"), shard=1000)
    n, asked = vecs.count(), [r["embedding"] for r in vecs.filter("doc_id % 200 = 0").collect()]
    hits = looked = 0
    for q in asked[:6]:
        hits += len({r["doc_id"] for r in scan(vecs, q, 10).collect()} & {r["doc_id"] for r in index.search(q, 10).collect()})
        looked += sum(r["looked"] for r in index.looked_at(q).select("nodes", "looked").distinct().collect())
    assert hits >= 0.9 * 60 and looked < 0.5 * 6 * n and index.count() == n
    q = asked[0]
    exact = [tuple(r) for r in scan(vecs, q, 40).collect()]
    best = exact[0][0]
    index.remove(vecs.filter(F.col("doc_id") == best))
    assert index.count() == n - 1 and [tuple(r) for r in index.search(q, 1).collect()] == exact[1:2]
    index.add(vecs.filter(F.col("doc_id") == best).withColumn("embedding", F.transform("embedding", lambda x: -x)))  # it moves to another place
    assert index.count() == n and [tuple(r) for r in index.search(q, 1).collect()] == exact[1:2]
    index.add(vecs.filter(F.col("doc_id") == best))
    assert [tuple(r) for r in index.search(q, 1).collect()] == exact[:1] and index.count() == n
    index.clear()
    assert index.count() == index.search(q, 5).count() == 0
    assert not GraphIndex(spark, str(tmp_path / "none")).exists()


def test_many_questions_of_a_graph_index_are_one_pass(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 32)))]
    vecs = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    index = GraphIndex.create(vecs, str(tmp_path / "g"), shard=100)
    index.remove(vecs.filter("doc_id % 7 = 0"))
    asked = vecs.filter("doc_id % 30 = 0").selectExpr("doc_id as question", "embedding as q")
    live = vecs.filter("doc_id % 7 <> 0")
    found, exact = (sorted(map(tuple, df.collect())) for df in (index.search_many(asked, 10), scan_many(live, asked, 10)))
    assert len({(q, d) for q, d, _ in found} & {(q, d) for q, d, _ in exact}) >= 0.9 * 500
    mine = [(d, s) for q, d, s in sorted(found, key=lambda r: (-r[2], r[1])) if q == 30]
    assert mine == [tuple(r) for r in index.search(rows[30][1], 10).collect()]


def test_many_questions_of_a_vector_index_are_one_pass(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)))] + [(i, [1.0] * 8) for i in range(900, 960)] + [(961, [0.0] * 8)]
    vecs = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    index = VectorIndex.create(vecs, str(tmp_path / "v"))
    index.remove(vecs.filter("doc_id % 5 = 0"))
    asked = vecs.filter("doc_id in (0, 7, 33, 900)").selectExpr("doc_id as question", "embedding as q")
    for many, one in (
        (index.search_many(asked, 10), lambda q: index.search(q, 10)),
        (index.search_many(asked, 770), lambda q: index.search(q, 770)),  # more hits than there are
        (scan_many(vecs, asked, 10), lambda q: scan(vecs, q, 10)),
    ):
        by_question = {}
        for r in many.collect():
            by_question.setdefault(r["question"], []).append((r["doc_id"], r["score"]))
        assert by_question.keys() == {0, 7, 33, 900}
        for q, found in by_question.items():
            assert sorted(found, key=lambda h: (-h[1], h[0])) == [tuple(r) for r in one(rows[q][1]).collect()]


def test_every_node_of_a_graph_can_be_reached():
    rng = np.random.default_rng(1)
    x = units(np.concatenate([rng.normal(size=(60, 8)) * 0.01 + c for c in np.eye(8)[:5]] + [np.ones((40, 8))]))  # clusters far from each other, and many equal vectors
    levels = rng.integers(0, 3, len(x))
    links = graph(list(range(len(x))), levels, x)
    first = max(range(len(x)), key=lambda i: (levels[i], -i))
    seen, todo = {first}, [first]
    while todo:
        for j in links[todo.pop()][0]:
            if j not in seen:
                seen.add(j)
                todo.append(j)
    assert len(seen) == len(x) and all(len(own) == level + 1 for own, level in zip(links, levels))
    for q in (x[0], x[100], x[310]):
        found, _ = walk(list(range(len(x))), levels.tolist(), links, x, q, 64)
        assert round(found[0][0], 9) == 1.0


def test_vector_index_separates_clusters(spark, tmp_path):
    rows = [(k, [1.0 + 0.01 * k, 0.0, 0.0]) for k in range(20)] + [(100 + k, [0.0, 1.0, 0.01 * k]) for k in range(20)] + [(999, [0.0, 0.0, 0.0]), (998, [])]
    index = VectorIndex.create(spark.createDataFrame(rows, "doc_id long, embedding array<float>"), str(tmp_path / "c"), cells=2)
    assert index.count() == 40 and {r["doc_id"] // 100 for r in index.search([0.0, 2.0, 0.1], 20, share=0.1).collect()} == {1}


def test_pq_index_and_its_codebook_file(spark, tmp_path):
    vecs = vectors(spark, "/root/testdata/sf0.001").select("doc_id", "embedding")
    index = PqIndex.train(vecs, str(tmp_path / "pq"))
    again = PqIndex(spark, str(tmp_path / "pq"))
    index.add(vecs)
    assert again.count() == vecs.count() and sorted(map(tuple, again.codebook().collect())) == sorted(map(tuple, index.codebook().collect()))
    q = vecs.filter("doc_id = 0").first()["embedding"]
    found = [r["doc_id"] for r in again.search(q, 10).collect()]
    codes = {r["doc_id"]: r["codes"] for r in again.codes().collect()}
    book = {(r["sub"], r["code"]): r["centroid"] for r in again.codebook().collect()}
    parts = [q[8 * s : 8 * s + 8] for s in range(8)]
    exact = sorted((round(sum((a - b) ** 2 for s in range(8) for a, b in zip(parts[s], book[s, c[s]])), 6), i) for i, c in codes.items())
    assert found == [i for _, i in exact[:10]]
    index.remove(vecs.filter("doc_id = 0"))
    assert again.count() == vecs.count() - 1 and 0 not in {r["doc_id"] for r in again.search(q, 10).collect()}
    assert again.memory() == {"codes": 8 * again.count(), "codebook": 4 * 16 * 64, "vectors": 256 * again.count()}


def test_keys_of_all_users_and_events_equal_brute_force(spark, tmp_path):
    from larkspur import catalog

    start = datetime.datetime(2024, 1, 20)
    rows = [(k, k * 7 % 31 if k % 13 else None, start + datetime.timedelta(hours=k), f"type{k % 3}") for k in range(200)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    users = {u for _, u, _, _ in rows if u is not None}
    got = {tuple(r) for r in catalog.QUERIES["admin_or_owner"](spark, str(tmp_path)).collect()}
    assert got == {(u, sum(u % 10 == 0 or u == v for _, v, _, _ in rows)) for u in users} and max(users) > 12
    last = {u: max(t for _, v, t, _ in rows if v == u) + datetime.timedelta(days=u % 3 * 10) for u in users}
    live = {u for u in users if last[u] > datetime.datetime(2024, 2, 5)}
    got = sorted(tuple(r) for r in catalog.QUERIES["apikey_user_resolution"](spark, str(tmp_path)).collect())
    assert got == [(k, u, u % 10 == 0) for k, u, _, _ in rows if u in live] and len({k % 3 for k, _, _ in got}) == 3


def test_chunks_of_all_documents_equal_brute_force(spark, tmp_path):
    from larkspur import catalog

    docs = [(k, f"text of {k}", "en" if k % 2 else "de", "src") for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["path"] for r in catalog.QUERIES["chunk_by_id"](spark, str(tmp_path)).collect()}
    assert got == {k: f"docs/src/{k}.txt" for k in range(1, 60, 2)}


def test_embedding_holds_few_texts_at_once():
    from larkspur.operators import embed

    batch = pa.RecordBatch.from_pydict({"id": list(range(5000)), "text": [None, "x" * (1 << 20)] * 5 + ["short"] * 4990})
    parts = list(embed.slices(batch, "text"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows <= embed.SLICE_ROWS and sum(len(t or "") for t in p.column("text").to_pylist()) <= embed.SLICE_BYTES for p in parts)


def test_a_watched_folder_is_handed_on_in_small_batches(tmp_path):
    from larkspur.streaming import watch

    (tmp_path / "in").mkdir()
    for i in range(50):
        (tmp_path / "in" / f"{i:02d}.txt").write_bytes(bytes([i]) * (1 << 20))
    reader = watch.FolderReader(str(tmp_path / "in"), str(tmp_path / "state"))
    end = reader.latestOffset()
    batches = [b for p in reader.partitions({"listing": -1}, end) for b in reader.read(p)]
    assert all(b.nbytes <= watch.READ_BYTES + (2 << 20) for b in batches)
    seen = {r["path"]: r for b in batches for r in b.to_pylist()}
    assert len(seen) == 50 and all(r["change"] == "created" and len(r["content"]) == r["file_size"] == 1 << 20 for r in seen.values())


def test_postings_of_documents_made_by_themselves(spark, tmp_path, monkeypatch):
    from larkspur.operators import textindex

    monkeypatch.setattr(textindex, "AT_ONCE", 3)
    docs = spark.createDataFrame([(1, "b a b", "x"), (2, "", "x x"), (3, None, "c"), (1, "a z", "x")], "doc_id long, text string, more string")
    index = textindex.TextIndex.build(docs, str(tmp_path / "i"), {"text": "text", "more": "more"})
    found = sorted((r["term"], r["field"], r["key"], r["tf"], tuple(r["pos"])) for r in index.postings(["a", "b", "c", "x", "z"]).collect())
    assert found == [("a", "text", 1, 2, (0, 1)), ("b", "text", 1, 2, (0, 2)), ("c", "more", 3, 1, (0,)), ("x", "more", 1, 2, (0, 0)), ("x", "more", 2, 2, (0, 1)), ("z", "text", 1, 1, (1,))]


def test_postings_are_made_without_a_shuffle_of_positions(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(20)], "doc_id long, text string")
    index = TextIndex.build(docs, str(tmp_path / "i"), {"text": "text"})
    assert "Exchange" not in index._postings_of(index._tables("forward"), {"text": 3.0})._jdf.queryExecution().executedPlan().toString()


def test_counted_terms_of_keys_of_one_row_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(20)], "doc_id long, text string")
    assert "Exchange" not in fulltext.postings(docs)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("repeated", [50_000, 2, 1])
def test_counted_terms_equal_those_counted_by_hand(spark, monkeypatch, repeated):
    monkeypatch.setattr(fulltext, "REPEATED", repeated)  # two keys are repeated, one of them null
    rows = [(1, "b a b"), (2, ""), (3, None), (4, "Élan élan ELAN x"), (None, "b c"), (None, "b"), (5, "a, b; a"), (5, "a"), (5, None), (6, "z " * 50 + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for key, text in rows:
        for term in fulltext.query_terms(text or ""):
            want[term, key] = want.get((term, key), 0) + re.findall(r"[^\W_]+", fulltext.fold(text)).count(term)
    found = [tuple(r) for r in fulltext.postings(docs).collect()]
    assert dict(((t, k), n) for t, k, n in found) == want and len(found) == len(want)
    assert fulltext.postings(docs).dtypes == [("term", "string"), ("doc_id", "bigint"), ("tf", "bigint")]
    assert fulltext.postings(docs.limit(0)).count() == 0


def test_counted_terms_do_not_depend_on_how_many_are_counted_at_once(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([7, None, 9, 7]), pa.array([["b", "a", "b"], [], ["a"], ["c", "b", "a", "c"]])], names=["k", "terms"])
    want = [("a", 7, 1), ("a", 7, 1), ("a", 9, 1), ("b", 7, 1), ("b", 7, 2), ("c", 7, 2)]
    for at_once in (1, 3, 4, 100):
        monkeypatch.setattr(fulltext, "AT_ONCE", at_once)
        assert sorted(tuple(r.values()) for b in fulltext.counted(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()) == want


def test_tokens_of_texts_with_and_without_marks(spark):
    texts = ["", " ", "--", "One, two;three ", "ÀÉ éa-Ÿ", "İx \u212a", "ΟΔΟΣ", "日本 語1", "a\u0301b", None]
    plain = F.filter(F.split(F.translate(F.lower("t"), T.MARKED, T.PLAIN), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and rows[3]["a"] == ["one", "two", "three"] and rows[4]["a"] == ["ae", "ea", "y"] and rows[-1]["a"] is None


def test_pdf_codes_of_one_size_are_read_as_those_of_several():
    one = pdf.Font(None, True)
    one.map = {b"\0\1": "a", b"\0\2": "bc"}
    several = pdf.Font(None, True)
    several.map, several.sizes = one.map, [2, 3]
    for raw in (b"", b"\0\1", b"\0\1\0\2\0\3\0\1", b"\0\1\0"):
        assert one.read(raw) == several.read(raw)
