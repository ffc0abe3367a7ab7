"""Near duplicates, nearest neighbours, language, HTML, toxicity: brute force, held-out figures and edge cases."""

from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from conftest_llm import prose
from tests_llm_helpers import rows_of

from larkspur.llm import ann, components, html, language, near, toxic
from larkspur.llm.common import bounded_sample, table


def brute_classes(docs: dict[int, str], threshold=0.8):
    sets = {i: frozenset(near.shingles(t or "").tolist()) for i, t in docs.items()}
    up = {i: i for i in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(docs, 0)
    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (root(i), links[i]) for i in docs}


def crowd(n: int = 60) -> dict[int, str]:
    """Copies, near copies of several grades, and texts that share one long passage."""
    rng = random.Random(9)
    shared = prose(77, 80)
    docs = {}
    for g in range(6):
        words = prose(100 + g, 150).split()
        for k in range(8):
            new = list(words)
            for _ in range(k // 2):
                new[rng.randrange(len(new))] = f"edit{rng.randrange(1000)}"
            docs[len(docs)] = " ".join(new)
    while len(docs) < n:
        docs[len(docs)] = shared + " " + prose(500 + len(docs), rng.randrange(5, 120))
    return docs


def check_classes(spark, docs):
    got = rows_of(near.near_duplicates(spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(3)), "doc_id")
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == brute_classes(docs)


def test_near_duplicates_equal_brute_force(spark):
    check_classes(spark, crowd())


def test_near_duplicates_with_small_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "LEAF", 6)
    monkeypatch.setattr(near, "BLOCK", 3)
    check_classes(spark, crowd())


def all_links(texts: list[str], threshold=0.8) -> dict[int, int]:
    """Number of texts at the threshold or above for each text: every pair that shares one of its rarest shingles is compared, which misses none."""
    sets = [near.shingles(t).tolist() for t in texts]
    often = Counter(x for s in sets for x in s)
    holders, links = {}, dict.fromkeys(range(len(sets)), 0)
    as_sets = [set(s) for s in sets]
    for i, s in enumerate(sets):
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1]
        for j in {j for x in rare for j in holders.get(x, ())}:
            both = len(as_sets[i] & as_sets[j])
            if both >= threshold * (len(s) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
        for x in rare:
            holders.setdefault(x, []).append(i)
    return links


@pytest.mark.parametrize("leaf", [4096, 16])
def test_near_duplicates_find_all_links_of_the_table(spark, monkeypatch, leaf):
    """On the table no link is lost, also where buckets are split again and again."""
    monkeypatch.setattr(near, "LEAF", leaf)
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    want = all_links([t or "" for _, t in rows])
    got = {r["doc_id"]: r["n_links"] for r in near.near_duplicates(documents).collect()}
    assert sum(want.values()) > 150 and [got[i] for i, _ in rows] == [want[k] for k in range(len(rows))]


def test_near_duplicates_on_edge_cases(edge):
    rows = near.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    got = {r["doc_id"]: r for r in rows}
    assert got[6]["class_id"] == got[7]["class_id"] == got[8]["class_id"] == 6
    assert got[6]["n_text_links"] == 1 and got[6]["n_links"] == 3  # a copy, a repeated row, a near copy
    assert got[0]["n_links"] == got[1]["n_links"] == 0
    kept = near.keep_one(edge)
    assert kept.columns == edge.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows} - {r["doc_id"] for r in rows if r["doc_id"] != r["class_id"]}


def test_documents_without_id_neither_hide_their_class_nor_join_others(spark):
    a, b, c, other = prose(61, 90), prose(62, 90), prose(63, 90), prose(64, 90)
    near_a = a.replace(a.split()[40], "changed", 1)
    rows = [(None, a), *((k, a) for k in range(10, 40)), (40, near_a), (None, b), (None, b), (50, b), (None, c), (60, other), (61, other), (7, a + " " + b), (7, c + " " + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in near.near_duplicates(df).collect()}
    assert got == {(None, 10, 31, 1), *((k, 10, 31, 1) for k in range(10, 40)), (40, 10, 31, 1), (None, 50, 2, 0), (50, 50, 2, 0), (None, None, 0, 0), (60, 60, 1, 0), (61, 60, 1, 0), (7, 7, 0, 0)}
    kept = sorted(((r["doc_id"], r["text"]) for r in near.keep_one(df).collect()), key=repr)
    assert kept == sorted([(None, a), (None, b), (None, b), (None, c), (60, other), (7, a + " " + b), (7, c + " " + other)], key=repr)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (None, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


def brute_nearest(rows, every=100, k=10):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    return {q: sorted((float(np.sqrt(((good[c] - good[q]) ** 2).sum())), c) for c in good if c != q)[:k] for q in good if q % every == 0}


def test_nearest_recall(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    got = ann.nearest(vectors).collect()
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    hits = [(q, c) in found for q, best in want.items() for _, c in best]
    assert sum(hits) >= 0.9 * len(hits)
    for q, best in want.items():
        for s, c in best:
            assert (q, c) not in found or found[q, c] == pytest.approx(s, abs=1e-12)


def test_nearest_recall_on_more_vectors(spark):
    test_nearest_recall(spark, "/root/testdata/sf0.1")


def test_nearest_looks_at_windows_only(spark):
    """With one order, all that is found lies within the window around the query's place, and what lies well within is found by exact distance."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 6)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, k=5, window=0.02, curves=1).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    keys = ann.Curves(6, float(np.linalg.norm(v, axis=1).max()), 1).keys(v, np.arange(3000))[0]
    place = np.empty(3000, int)
    place[np.lexsort((np.arange(3000), keys))] = np.arange(3000)
    assert set(got) == set(range(0, 3000, 100))
    for q, found in got.items():
        gap = np.abs(place - place[q])
        assert all(gap[c] <= 0.02 * 3000 + 6 for c in found)
        inner = [c for c in np.flatnonzero(gap <= 0.02 * 3000 - 6).tolist() if c != q]
        worst = max(np.linalg.norm(v[c] - v[q]) for c in found)
        assert all(c in found for c in inner if np.linalg.norm(v[c] - v[q]) < worst)


def test_nearest_in_small_windows_of_vectors_with_structure(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 32))
    v = (centres[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 3)) @ rng.normal(size=(3, 32))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    want = brute_nearest(list(enumerate(v.tolist())))
    found = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, window=0.004, curves=8).collect()}
    hits = [(q, c) in found for q, best in want.items() for _, c in best]
    assert sum(hits) >= 0.9 * len(hits)


def test_nearest_with_an_id_of_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [9.0, 9.0]), (1, [1.0, 1.0]), (2, [9.0, 8.0]), (2, [5.0, 5.0])]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2)] and got[1][3] == pytest.approx(41**0.5)


def test_nearest_with_ties_nulls_and_a_common_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 60)] + [(i, rng.normal(size=3).tolist()) for i in range(60, 130)]
    rows += [(200, None), (300, []), (400, [0.0, 0.0, 0.0]), (500, [1.0, None, 2.0]), (600, [float("nan"), 1.0, 1.0]), (700, [float("inf"), 1.0, 1.0]), (800, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (3, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = {}
    for r in ann.nearest(df, window=0.6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 800]
    want = brute_nearest(dict(single).items())
    assert set(got) == set(want)
    for q, best in want.items():
        assert [c for _, c, _ in sorted(got[q])] == [c for _, c in best]
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few).collect()] == [(0, 1, 1, 1.0)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_hilbert_keys_walk_through_neighbouring_cells():
    side = np.arange(8)
    cells = np.array([(a, b, c) for a in side for b in side for c in side])
    keys = ann.hilbert_keys(cells, 3)
    order = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def without_names(k: int, host: str, rng) -> tuple[int, str, str, str]:
    """A page of a site without telling names, and its article's text: every page has a menu, some a section's note, the article and its quotation differ."""
    words = ["alder", "birch", "cedar", "elm", "fir", "hazel", "larch", "maple", "oak", "pine", "rowan", "willow"]
    article = [" ".join(rng.choice(words, 30).tolist()) + f" {k}" for _ in range(2)] + ["A line that many articles quote."] * (k % 5 < 2)
    note = "<section><p>Winter hours</p><div>Closed on Sundays</div></section>" if k % 3 == 0 else ""
    body = "".join(f"<p>{x}</p>" for x in article)
    html_text = f"<html><body><div><ul><li><a href='/{host}'>Start of {host}</a></li><li><a href='/x'>All of it</a></li></ul></div>{note}<article>{body}</article><div>All rights are {host}'s</div></body></html>"
    return k, f"http://{host}/{k}", html_text, "\n".join(article)


def test_html_templates_equal_a_counter_by_host(spark):
    """The query's texts are those that templates from plain counting give, and templates alone, without names or article elements, leave the articles."""
    rng = np.random.default_rng(4)
    pages = [without_names(k, f"site{k % 2}.example", rng) for k in range(80)]
    pages += [pages[5], (900, None, None, ""), (901, "http://alone.example/", "<p>One</p>", "One")]
    pages = [(i, u, None if h is None else h.replace("<article>", "<div>").replace("</article>", "</div>"), t) for i, u, h, t in pages]
    pages = [(i, u, None if h is None else h.replace("<p>A line that many articles quote.</p>", ""), t.replace("\nA line that many articles quote.", "")) for i, u, h, t in pages]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(5)
    count, beside, of_host = Counter(), {}, Counter()
    for _, url, text, _ in pages:
        host = html.host_of(url)
        of_host[host] += 1
        for (h, kind), mask in html.template_evidence(text or "").items():
            count[host, h, kind] += 1
            beside[host, h, kind] = beside.get((host, h, kind), 0) | mask
    templates = {}
    for (host, h, kind), n in count.items():
        many = html.SOME if kind == html.KINDS["block"] else html.MANY
        if n >= html.LEAST_PAGES and (n >= html.SHARE * of_host[host] or beside[host, h, kind].bit_count() >= many and n >= html.FEW * of_host[host]):
            templates.setdefault(host, set()).add(h)
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect())
    assert got == sorted((i, t, len(t)) for i, u, h, _ in pages for t in [html.main_text(h or "", frozenset(templates.get(html.host_of(u), ())))])
    for _, url, text, article in pages:
        assert html.main_text(text or "", frozenset(templates.get(html.host_of(url), ())), names=False) == article
    assert sum(html.main_text(h, names=False) != t for _, _, h, t in pages[:80]) == 80  # without templates every page shows its menu


def test_html_keeps_what_articles_quote(spark):
    rng = np.random.default_rng(5)
    pages = [without_names(k, "one.example", rng) for k in range(60)]
    got = rows_of(html.extract(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")), "page_id")
    assert [got[k]["text"] for k in range(60)] == [p[3] for p in pages]


def test_html_templates_act_on_the_table(spark):
    pages = table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url", "html")
    templates = {r["host"]: frozenset(r["templates"]) for r in html.host_templates(html.page_counts(pages)).collect()}
    rows = pages.collect()
    alone = [html.main_text(r["html"], templates.get(html.host_of(r["url"]), frozenset()), names=False) for r in rows]
    assert sum(t != html.main_text(r["html"], names=False) for t, r in zip(alone, rows)) > 400


def planted_host(k: int, rng) -> tuple[int, str, str, str]:
    """A page of a host that puts a notice and an advert into every article, and its article's text. A fifth of the articles are near copies of one, a third quote a passage."""
    words = [f"{a}{b}" for a in "al bir ce el fi ha lar ma oa pi".split() for b in "der ch dar m r zel ple k ne row".split()]
    lines = [" ".join(rng.choice(words, 25).tolist()) for _ in range(4)]
    if k % 5 == 0:
        lines = [f"One article of which the host has copies, part {i}, with enough words to be long" for i in range(5)]
        lines[k // 5 % 5] += f" and edit {k}"
    if k % 3 == 0:
        lines.insert(2, "A passage that many articles of this host quote, word for word.")
    body = [f"<p>{x}</p>" for x in lines]
    body.insert(1, "<p>This article is free to read thanks to our members.</p>")
    body.append("<ul><li><a href='/m'>More of this</a></li><li><a href='/n'>Newest first</a></li></ul>")
    return k, f"http://planted.example/{k}", f"<body><div>Menu of it all</div><article><h1>Title {k}</h1>{''.join(body)}</article></body>", "\n".join([f"Title {k}", *lines])


def test_html_boilerplate_inside_articles_goes_and_quotations_and_copies_stay(spark):
    rng = np.random.default_rng(6)
    pages = [planted_host(k, rng) for k in range(100)]
    got = rows_of(html.extract(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(4)), "page_id")
    assert [got[k]["text"] for k in range(100)] == [p[3] for p in pages]
    # near copies of one article on nearly all pages of a host
    copies = [(k, "http://copies.example/", f"<article>{''.join(f'<p>{prose(i, 20)}{k if i == k % 6 else chr(32)}</p>' for i in range(6))}</article>") for k in range(60)]
    kept = rows_of(html.extract(spark.createDataFrame(copies, "page_id long, url string, html string")), "page_id")
    assert all(len(kept[k]["text"].split("\n")) == 6 for k in range(60))


def test_html_names_do_not_take_the_article():
    for name in ("social-history", "share-knowledge", "search-engines", "tags-explained", "comment-analysis", "notice-period-law", "widget-theory", "ad", "sidebar", "comments-of-kant", "page-menu"):
        for page in ("<article><h1>T</h1><div class='{}'><p>{}</p></div></article>", "<body><form class='{}'><h1>T</h1><p>{}</p></form><nav>Menu</nav></body>", "<article><h1>T</h1><p class='{}'>{}</p></article>"):
            assert html.main_text(page.format(name, prose(3, 40))) == "T\n" + prose(3, 40), (name, page)
    page = "<article><h1>T</h1><p>{}</p><div class='{}'>Some words</div></article>"
    for name in ("ad", "site-nav", "share", "cookie-banner", "comments-area", "postTags", "widget", "sidebar-left"):
        assert html.main_text(page.format(prose(4, 40), name)) == "T\n" + prose(4, 40), name
    for name in ("social-history", "search-engines", "widget-theory", "loader", "shared", "tagsoup"):
        assert html.main_text(page.format(prose(4, 40), name)).endswith("Some words"), name
    assert html.main_text("<div hidden><article><p>never shown</p></article></div><p>shown</p>") == "shown"
    assert html.main_text("<article><h1>Only a title</h1></article><nav>Menu</nav>") == "Only a title"


def test_html_markup_of_any_kind_takes_linear_time():
    for markup in ("<div>" * 40000, "<b>" * 20000 + "<div>" * 20000, "</x>" * 40000 + "<i>" * 40000, '<a ">"' * 20000, "<!" * 100000, "<li><ul>" + "<div>" * 10000 + "<li>x</li>" * 10000, "<p>" + "<i>" * 10000 + "<div>x</div>" * 10000, "<form>" * 10000 + "word " * 10000, "<article>" + "<section class=ad>" * 10000 + "word " * 10000):
        start = time.process_time()
        html.main_text(markup, frozenset([1]), frozenset([2]))
        html.template_evidence(markup)
        assert time.process_time() - start < 8


def test_html_with_clashing_columns_and_a_very_long_page(spark):
    long = "<article><p>" + "word " * 300000 + "</p></article>"
    rows = [(1, "http://a/", long, "x", 1, "h"), (1, "http://a/", long, "x", 1, "h"), (2, None, "", None, None, None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, host string")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 1499999, 1499999]


def test_language_on_held_out_documents(spark):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language.predict(documents, language.fit(documents)).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}


def test_language_path_equals_plain_viterbi():
    rng = np.random.default_rng(3)
    for _ in range(60):
        scores = rng.normal(size=(rng.integers(1, 40), 3)) * 4
        best = {(k,): scores[0, k] for k in range(3)}
        value = scores[0].copy()
        total = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 6 * sum(a != b for a, b in zip(p, p[1:]))
        for i in range(1, len(scores)):
            value = np.array([max(value[j] - 6 * (j != k) for j in range(3)) + scores[i, k] for k in range(3)])
        assert total(language.best_path(scores, 6).tolist()) == pytest.approx(value.max()) and best


def test_language_path_with_a_stretch_at_either_end():
    scores = np.array([[-8.0, -17.0, -11.0]] * 3 + [[-17.0, -8.0, -11.0]] * 3)  # each end gains 9 over the third language, a change costs 12
    assert language.best_path(scores, 12).tolist() == [0, 0, 0, 1, 1, 1]


@pytest.mark.parametrize("languages", [2, 3, 4, 5])
@pytest.mark.parametrize("penalty", [0.0, 0.5, 3.0, 12.0])
def test_language_path_equals_all_paths(languages, penalty):
    rng = np.random.default_rng(languages)
    for k in range(60):
        n = int(rng.integers(1, {2: 9, 3: 7, 4: 6, 5: 5}[languages]))
        scores = rng.normal(size=(n, languages)) * (1, 4, 12)[k % 3]
        paths = np.array(list(product(range(languages), repeat=n)))
        worth = scores[np.arange(n), paths].sum(axis=1) - penalty * (paths[:, 1:] != paths[:, :-1]).sum(axis=1)
        own = language.best_path(scores, penalty)
        assert scores[np.arange(n), own].sum() - penalty * (own[1:] != own[:-1]).sum() == pytest.approx(worth.max())


def test_language_of_repeated_rows_ties_and_one_id(spark):
    """Equal texts get equal results, ties go to the smaller name, and one id that a table is full of cannot be the sample."""
    model = language.Model([("abc", "xx"), ("abc", "aa"), ("zzz", "xx"), ("zzz", "aa")])
    assert language.Labeller(model).label("abc")[0] == "aa"
    rows = [(7, f"one id {k}", "en") for k in range(400)] + [(k, "der und die das", "de") for k in range(8, 40)] + [(9, "der und die das", "de")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(docs, 64).languages == ["de"]
    assert len({(r["lang_pred"], r["score"]) for r in language.predict(docs, language.fit(docs)).filter("doc_id = 9").collect()}) == 1


def test_language_edge_cases(spark, edge, empty):
    texts = [("the and of to in", "en"), ("der und die das ist", "de"), ("привет мир как дела", "ru")] * 3
    model = language.Model(texts)
    by = language.Labeller(model)
    assert by.label("")[0] == by.label("123 ... !")[0] == "und"
    assert by.label("привет")[0] == "ru" and by.label("the of")[0] == "en"
    assert [s[2] for s in by.spans("the and of to in the and of привет мир как дела")] == ["en", "ru"]
    texts = ["the and of to in the and of привет мир как дела", " -- 12 the and of, to 3 ..", "привет", "", "12 -- \n", "x", "\u2003the_and of\u0085 7"]
    for text, (name, score, spans) in zip(texts, by.labels_and_spans(texts)):
        assert (name, score) == by.label(text) and spans == by.spans(text), text
    got = rows_of(language.predict(edge, model), "doc_id")
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[4]["lang_pred"] != "und"
    nothing = language.fit(empty)
    assert {r["lang_pred"] for r in language.predict(edge, nothing).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<header><h2>Site</h2></header><div class="cookie-notice">We use cookies</div><article><h1>Head&nbsp;line &amp; more</h1><p>First <b>bold</b>
 text<p>Second<br>line<form><input>Sign up</form><aside>Side</aside></article><section id="comments"><p>Reader</p></section><footer>&copy;</footer></body></html>"""


def test_html_main_text():
    assert html.main_text(PAGE) == "Head line & more\nFirst bold text\nSecond line"
    assert html.main_text("") == "" and html.main_text("plain &lt;text&gt;") == "plain <text>"
    assert html.main_text("<p>a<p>b</div></p>c<!-- no") == "a\nb\nc"
    assert html.main_text("<div>" * 20000 + "deep") == "deep"
    assert html.main_text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\nb\nc\nd"
    assert html.main_text('<p title="a > b">x</p><p title="unclosed>y</p>') in ("x", "x\ny")


def test_html_templates_go_by_host(spark, empty):
    page = "<body><div><p>Subscribe to all of our letters</p></div><div><p>{}</p></div></body>"
    rows = [(k, f"https://www.A.example/{k}", page.format(prose(k, 20)), "x") for k in range(8)] + [(50 + k, f"http://b{k}.example/", page.format(prose(k, 20)), "x") for k in range(3)]
    rows += [(90, None, None, "x"), (91, "not a url", "", "x"), (92, None, "<p>only</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = rows_of(html.extract(df), "page_id")
    assert len(got) == len(rows)
    for k in range(8):
        assert got[k]["text"] == prose(k, 20)
    assert got[50]["text"].startswith("Subscribe") and got[90]["text"] == got[91]["text"] == "" and got[92]["text"] == "only"
    assert got[0]["n_chars"] == len(got[0]["text"]) and got[0]["url"] == "https://www.A.example/0"
    assert html.extract(df.limit(0)).count() == 0


def test_templates_of_a_part_of_a_host_go(spark):
    """Five layouts of a host, each with a section on a fifth of the pages; a body that pages beside changing boxes share stays."""
    layout = "<body><div><div>Part {} of the house keeps its own words here</div></div><div><h1>{}</h1><p>{}</p></div></body>"
    rows = [(k, "http://d.example/", layout.format(k % 5, prose(9000 + k, 4), prose(k, 30))) for k in range(150)]
    shared = "<body><div><p>" + prose(7777, 60) + "</p></div><div><span>{}</span></div></body>"
    rows += [(1000 + k, "http://d.example/", shared.format(prose(8000 + k, 8))) for k in range(30)]
    got = rows_of(html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)), "page_id")
    for k in range(150):
        assert got[k]["text"] == prose(9000 + k, 4) + "\n" + prose(k, 30)
    for k in range(30):
        assert got[1000 + k]["text"] == prose(7777, 60) + "\n" + prose(8000 + k, 8)


def test_copies_of_an_article_on_one_host_stay(spark):
    page = "<article><h1>Same</h1><p>" + prose(1, 30) + "</p></article>"
    df = spark.createDataFrame([(k, "http://c.example/", page) for k in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in html.extract(df).collect()} == {"Same\n" + prose(1, 30)}


def labelled(n=600):
    rng = random.Random(8)
    rows = []
    for k in range(n):
        bad = k % 5 == 0
        words = prose(1000 + k, 60).split()
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["rotten", "vermin"])
        rows.append((k, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxic.Model([(t, y) for _, t, y in labelled()])


def test_toxicity_finds_disguised_words(model):
    scorer = toxic.Scorer(model)
    for text in ("you rotten thing", "you r0tt3n thing", "r o t t e n", "ve.r.m.in", "rrrottten", "V3RM1N!!", "v-e-r-m-i-n"):
        assert scorer.score(prose(1, 20) + " " + text + " " + prose(2, 20)) >= toxic.THRESHOLD, text
    for text in (prose(3, 80), "", "12345 $$$ ***", "that*** is&&& fine%%%"):
        assert scorer.score(text) < toxic.THRESHOLD


def test_toxicity_reads_spaced_out_runs_from_every_offset(model):
    scorer = toxic.Scorer(model)
    spaced = " ".join
    for text in (spaced("youarerotten"), spaced("allofyouarevermin"), "y o u  a r e  r o t t e n  t o o", "y o u\na r e\nr o t t e n\nt o o", spaced("r0tt3npeople"), spaced("x" * 300 + "vermin"), spaced("alphabravorottencharlie")):
        assert scorer.score(prose(1, 20) + " " + text + " " + prose(2, 20)) >= toxic.THRESHOLD, text
    for text in (spaced("alphabravocharlie"), "a b c", "x y", "a l p h a  b r a v o", "1 2 3 4 - 5"):
        assert scorer.score(prose(1, 20) + " " + text + " " + prose(2, 20)) < toxic.THRESHOLD, text


def test_toxicity_reads_runs_of_two_and_three_letters():
    rows = [(prose(3000 + k, 30) + (" zq wvk " if k % 5 == 0 else " ") + prose(5000 + k, 30), int(k % 5 == 0)) for k in range(300)]
    scorer = toxic.Scorer(toxic.Model(rows))
    for text in ("z q", "w v k"):
        assert scorer.score(prose(1, 20) + " " + text + " " + prose(2, 20)) >= toxic.THRESHOLD, text


def test_spaced_out_runs_are_read_in_linear_time(model):
    import time

    took = []
    for n in (4000, 32000):
        text = " ".join("vexo"[k % 4] for k in range(n))
        start = time.process_time()
        toxic.spaced_words(text, model.characters)
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0]


def test_toxicity_columns_and_rejection(spark, edge, empty, model):
    documents = spark.createDataFrame([(i, t, "c") for i, t, _ in labelled()], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled()] + [(None, 1), (3, None)], "doc_id long, toxic int")
    learned = toxic.fit(documents, labels, 400)
    rows = toxic.score_documents(documents, learned).collect()
    truth = {i: y for i, _, y in labelled()}
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 100 and all(r["predicted"] == truth[r["doc_id"]] for r in out)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)
    kept = toxic.reject(documents, learned)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {i for i, y in truth.items() if not y}
    assert toxic.score_documents(edge, learned).count() == edge.count()
    assert toxic.score_documents(empty, learned).count() == 0
    nothing = toxic.fit(documents, labels.limit(0))
    assert {r["score"] for r in toxic.score_documents(edge, nothing).collect()} == {0.0}


def test_toxicity_is_learned_from_all_labelled_rows(spark):
    """What Spark counts equals what is counted in memory, of more than 8000 rows, of near and exact copies, and of an id with many rows."""
    rows = [(k, prose(20000 + k, 8) + (f" r0tten vermin{k % 700}" if k % 6 == 0 else "") + (" s l i m e" if k % 90 == 0 else ""), int(k % 6 == 0)) for k in range(11200)]
    near_copies = [(20000 + k, prose(7, 60) + f" curse{k % 9}", 1) for k in range(400)]
    copies = [(30000 + k, "one text for all of these", k % 2) for k in range(400)] + [(40001, f"{prose(50000 + k, 6)} blight", 1) for k in range(900)]
    learn = [(i, t, y) for i, t, y in rows + near_copies + copies if zlib.crc32(str(i).encode()) % toxic.FOLDS != toxic.HELD_OUT]
    assert len(learn) > 9000 and any(i == 40001 for i, _, _ in learn)
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows + near_copies + copies] + [(1, None), (None, "nobody's")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(sorted({(i, y) for i, _, y in rows + near_copies + copies}), "doc_id long, toxic int")
    got, want = toxic.fit(documents, labels), toxic.Model([(t, y) for _, t, y in learn])
    assert got.limits == want.limits and got.without == want.without and got.shares == want.shares
    assert got.characters.three == want.characters.three and got.characters.one == want.characters.one
    assert "blight" in got.shares and "vermin*" in got.shares and len(toxic.without_copies([(t, y) for _, t, y in learn if "curse" in t])) < 20


def test_decoding_equals_all_readings(model):
    """The path found is the cheapest of all readings of a word; of equally cheap ones the smallest."""
    characters, rng = model.characters, random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("aeinorttv0134$*-xx") for _ in range(rng.randrange(1, 6)))
        costs = {}
        for choice in product(*[list(toxic.readings(word, i)) for i in range(len(word))]):
            said, cost, context = "", 0.0, "^^"
            for letter, price in choice:
                cost += price
                if letter:
                    cost += characters.cost(context, letter)
                    context, said = context[1] + letter, said + letter
            cost += characters.cost(context, "$")
            costs[said] = min(cost, costs.get(said, cost))
        least = min(costs.values())
        assert costs[toxic.decode(word, characters)] == pytest.approx(least)


def test_scores_equal_brute_force(spark, edge, model):
    """Every score is one minus the product of what its distinct words leave, without caches or early ends."""
    want = {}
    for r in edge.collect():
        words = toxic.words_of(r["text"] or "", model.characters)
        clean = 1 - model.without
        for w in words:
            clean *= 1 - max([model.shares.get(f, 0.0) for f in toxic.features(w)])
        want.setdefault(r["doc_id"], set()).add(round(1 - clean, 9))
    got = {}
    for r in toxic.score_documents(edge, model).collect():
        got.setdefault(r["doc_id"], set()).add(round(r["score"], 9))
        assert r["predicted"] == int(r["score"] >= toxic.THRESHOLD)
    assert got == want


def test_core_takes_signs_off_both_ends_in_linear_time():
    assert [toxic.core(x) for x in ("ab!!??", "$$$ab", "$$$$", "a$$b", "((ab))", "", "!!a!!b!!")] == ["ab", "ab", "", "a$$b", "ab", "", "a!!b"]
    start = time.process_time()
    toxic.core("x" + "$" * 300000 + "y")
    assert time.process_time() - start < 2


def test_limits_come_from_the_training_rows():
    rows = [(prose(3000 + k, 30) + (" zqwvk " if k % 5 == 0 else " ") + prose(5000 + k, 30), int(k % 5 == 0)) for k in range(300)]
    learned = toxic.Model(rows)
    assert learned.limits[0] in toxic.EVIDENCE and learned.limits[1] in toxic.LEAST_SHARE
    assert "zqwvk" in learned.shares and learned.without < 0.05
    assert toxic.Model([(f"word{k}", 1) for k in range(30)]).without > 0.9  # no clamp: where all are toxic, so is a text without features


def test_a_sample_is_bounded_in_rows_and_bytes(spark):
    documents = spark.createDataFrame([(7, f"t {k}") for k in range(500)] + [(k, prose(k, 20)) for k in range(100, 400)], "doc_id long, text string")
    found = bounded_sample(documents, 64, 10**6).collect()
    assert len(found) == 64 and all(r["doc_id"] != 7 for r in found)
    found = bounded_sample(documents, 64, 3000).collect()
    assert 0 < sum(len(r["text"]) for r in found) <= 3000


def test_columns_of_any_name_pass_rejection_and_redaction(spark, model):
    from larkspur.llm import lines, secrets

    row = (5, "a token = hunter2hunter2 here", 29, 1.5, "dot", (1,), {"k": [1, 2]})
    docs = spark.createDataFrame([row, (None, None, None, None, None, None, None)], "doc_id long, Text string, n_chars long, Score double, `a.b` string, `s t` struct<`x y`: int>, m map<string, array<int>>")
    assert [tuple(r) for r in toxic.reject(docs, model).filter("doc_id = 5").collect()] == [row]
    assert toxic.reject(docs, model).schema.names == docs.schema.names
    kept = secrets.redact(docs).filter("doc_id = 5").collect()[0]
    assert kept["Text"] == "a [assign] here" and kept["n_chars"] == 15 and kept["a.b"] == "dot" and kept["s t"]["x y"] == 1
    assert lines.dedup(docs).count() == near.keep_one(docs).count() == 2


def test_toxicity_held_out_on_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    some = documents.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxic.score_documents(some, toxic.fit(documents, labels)).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    hit = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert right >= 0.95 * len(rows) and sum(hit) >= 0.8 * len(hit)


