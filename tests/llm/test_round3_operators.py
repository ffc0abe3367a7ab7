"""Filter audit, hard negatives, quality rules: against SQL, brute force, and held-out labels; edge cases of each."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from larkspur.llm import audit, negatives, quality, registry

# --- filter audit


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_hard_negatives"])
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert oracle.compare(spark, duck, sf_dir, registry.QUERIES[name], registry.ORACLES[name]) is None


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_all_orders_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in audit.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert len(seen) == math.factorial(n) and len(set(seen)) == len(seen)


@pytest.mark.parametrize("k", [1, 2, 4])
def test_walk_equals_counting_each_order_anew(k):
    rng = random.Random(k)
    cells = [(mask, rng.randrange(9), rng.randrange(4), rng.randrange(3)) for mask in range(1 << k)]
    visited, shapley = audit.walk(cells, k)
    sums = [0] * k
    for order, steps in visited:
        gone, kept = 0, sum(n for _, n, _, _ in cells)
        for f, step in zip(order, steps):
            mine = [c for c in cells if c[0] >> f & 1 and not c[0] & gone]
            kept -= sum(c[1] for c in mine)
            assert step == [kept, *(sum(c[i] for c in mine) for i in (1, 2, 3))]
            sums[f] += step[1]
            gone |= 1 << f
    assert shapley == sums and len(visited) == math.factorial(k)


def audited(docs, labels):
    """By brute force, over rows (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    docs = [(i, t or "", lang or "") for i, t, lang in docs]
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    rows = []
    for i, t, part in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]
        own = [x for x in labels if x[0] == i and i is not None]
        rows.append((part, dict(zip("ABCDE", fails)), any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = set()
    for part in {r[0] for r in rows}:
        mine, removed, found = [r for r in rows if r[0] == part], {}, []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                fails = sum(r[1][f] for r in mine)
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                removed[f] = removed.get(f, 0) + len(here)
                found.append((f, (part, "".join(order), step, len(left), len(here), fails - len(here), only, sum(r[2] for r in here), sum(r[3] for r in here))))
        out |= {(*row, removed[f]) for f, row in found}
    return out


AUDIT_COLUMNS = ["part", "filter_order", "step", *audit.MEASURES, "shapley"]


def test_audit_of_edge_rows_equals_brute_force(spark, edge):
    labels = [(6, 1, 0), (6, 0, 1), (7, 1, None), (9, None, 1), (None, 1, 1), (12, 5, 7), (3, 1, 1)]
    flags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r) for r in audit.audit(audit.cells_of(edge, flags)).select(AUDIT_COLUMNS).collect()}
    docs = [tuple(r) for r in edge.select("doc_id", "text", "lang").collect()]
    assert got == audited(docs, labels)
    assert len(got) == 600 * len({d[2] for d in docs})


def test_audit_of_no_rows(spark, empty):
    assert audit.audit(audit.cells_of(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_audit_wants_a_few_filters(spark):
    with pytest.raises(ValueError):
        audit.audit(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "ABCDEFGHI")


# --- hard negatives


def mined(rows, every=100, positives=5, negatives_=10, low=30, high=90):
    """By brute force, over (vec_id, label, whole-number vector)."""
    out = set()
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in rows if i != a)
        for p, pid, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p]
            out |= {(a, pid, rank, i, -p, -s) for rank, (s, i, _) in enumerate(fit[:negatives_], 1)}
    return out


NEGATIVE_COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
VECTORS = "vec_id long, embedding array<float>, label int, score string, `list` string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", "clash") for i, v, label in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("clusters,group", [(1, 3), (64, 2), (256, 1000)])
def test_negatives_equal_brute_force_with_few_and_many_clusters(spark, clusters, group, monkeypatch):
    monkeypatch.setattr(negatives, "HELD", 50)
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * (0.1 if i % 2 else 1)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, rows[20][1], 1 if i < 40 else 2) for i in range(60)]  # a group of equal vectors: ties
    got = negatives.hard_negatives(vectors_of(spark, rows), every=20, sample=64, clusters=clusters, group=group)
    whole = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows]
    found = {tuple(r) for r in got.select(NEGATIVE_COLUMNS).collect()}
    assert found == mined(whole, every=20) and found


def test_negatives_skip_lists_that_cannot_have_them():
    """Far clusters are left out by their bounds: fewer scores are made than there are pairs, and nothing is lost."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 8)) * 1000
    x = np.rint(np.repeat(centres, 50, axis=0) + rng.normal(size=(800, 8)) * 5).astype(np.int64)
    own = negatives.nearest(x.astype(float), centres)
    order = np.argsort(own, kind="stable")
    x, own = x[order], own[order]
    radii = np.array([np.linalg.norm(x[own == c] - centres[c], axis=1).max(initial=0) for c in range(16)])
    model = negatives.Lists(centres, radii, np.bincount(own, minlength=16), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 8), np.int64))
    ids, labels = np.arange(800), np.zeros(800, np.int64)
    asked = negatives.Asked(ids[:20], labels[:20], x[:20], np.full((20, 1), negatives.LEAST), np.full((20, 1), negatives.MOST), 5, True)
    made = negatives.visit(asked, model, own, ids, labels, x)
    assert made < 20 * 800 / 4
    question, score, found = asked.found
    for q in range(20):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(800) if i != q)[:5]
        assert [(-int(s), int(i)) for s, i in zip(score[question == q], found[question == q])] == best


def test_negatives_of_edge_rows(spark):
    v = [0.5, 0.25, -0.5]
    rows = [
        (0, v, 1), (0, v, 1), (1, v, 1), (2, v, 2), (3, None, 1), (4, [None, 1.0, 1.0], 1), (5, [math.nan, 1.0, 1.0], 1), (6, [math.inf, 1.0, 1.0], 1), (None, v, 1), (7, v, None),
        (8, [0.0, 0.0, 0.0], 2), (9, [0.25, 0.25, -0.25], 2), (10, [1.0], 2), (11, [], 2), (100, [1e30, 0.0, 0.0], 3), (101, [1e30, -1e30, 0.0], 3), (102, [1e30, 0.0, 1.0], 4), (200, v, 9),
    ]
    got = {tuple(r) for r in negatives.hard_negatives(vectors_of(spark, rows)).select(NEGATIVE_COLUMNS).collect()}
    whole = {}
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            whole[i] = (i, label, [math.floor(min(max(256 * float(np.float32(c)), -negatives.LARGEST), negatives.LARGEST)) for c in x])
    assert got == mined(whole.values()) and got
    assert negatives.hard_negatives(vectors_of(spark, [])).count() == 0
    assert negatives.hard_negatives(vectors_of(spark, [(1, v, 1)])).count() == 0


def test_products_are_whole_numbers_at_any_size():
    big = np.array([[2**40 + 1, 3]])
    assert negatives.products(big, np.array([[2**20 + 1, 5]])).tolist() == [[(2**40 + 1) * (2**20 + 1) + 15]]


# --- quality rules


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


MEASURED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_measures_equal_brute_force(spark, edge):
    texts = ["a a a a", "a b a b a b", "x y\x1cz x y\x1cz", "\n\n \nline\nline\n line", "é" * 9 + " \U0001f600#|", "one two three\none two three"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = edge.select("doc_id", "text").filter("text is null or length(text) < 20000").unionByName(more)
    got = quality.judge(docs, quality.Model([], np.zeros(0, np.int64)))
    want = sorted((repr(r["doc_id"]), *measured(r["text"])) for r in docs.collect())
    assert sorted((repr(r["doc_id"]), *(r[c] for c in MEASURED)) for r in got.collect()) == want
    assert {r["kept"] for r in got.filter("not base_failed").collect()} == {True}
    assert got.filter("base_failed and kept").count() == 0


def test_quality_scores_equal_their_design():
    """Scoring by look-up gives what the fit's rows give."""
    texts = ["", "one", "a a a b", "Some words | of a text.\nAnd a line", "ü" * 40]
    weights = np.random.default_rng(1).normal(size=quality.SLOTS + 1)
    direct = quality.scores(texts, quality.Words(texts), weights)
    assert np.allclose(quality.Design(quality.shares(texts)).times(weights), direct, rtol=1e-4, atol=1e-4)
    each = [quality.scores([t], quality.Words([t]), weights)[0] for t in texts]
    assert np.allclose(each, direct)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.judge(docs, quality.fit(docs, labels)).filter("held_out").join(labels.withColumnRenamed("quality", "label"), "doc_id")
    right = found.filter((F.col("quality") >= quality.KEEP_AT) == (F.col("label") == 1)).count()
    assert right >= 0.95 * found.count() > 0
    assert found.filter("label = 1 and not base_failed and not kept").count() == 0


def test_quality_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000) * 3
    y = (rng.random(4000) < quality.sigmoid(0.7 * x - 1)).astype(np.int64)
    slope, offset = quality.calibrated(x, y)
    assert abs(slope - 0.7) < 0.1 and abs(offset + 1) < 0.2


def test_quality_without_labels_or_rows(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(edge, none)
    assert {r["quality"] for r in quality.judge(edge, model).collect()} == {1.0}
    assert quality.judge(empty, model).count() == 0
    bad = spark.createDataFrame([*((i, 0) for i in range(20)), (9, 3), (None, 1)], "doc_id long, quality int")
    assert all(r["quality"] < 0.5 for r in quality.judge(edge, quality.fit(edge, bad)).collect())
