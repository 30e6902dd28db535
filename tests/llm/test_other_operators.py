"""Extraction, toxicity, exact search and the pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoteverify.llm import html, topk, toxicity

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy this now please</div>
<article><h1>Title &amp; more</h1><p><b>First   part<br>of it &lt;tag&gt;, caf&eacute;&nbsp;here.<p>Second one with a <a href="x">link</a> and moreover some words.
<div class="sidebar">side words</div><ul><li>item one of the list<li>item two of the list</ul><form><input value="a"><p>Your name</p></form>
<p>Last words of the text.</p><section class="comments"><p>I like it a lot, thanks</p></section></article><!-- <p>hidden</p> --><aside>related</aside><footer>&copy; Foot</footer>"""
TEXT = "Title & more\n\nFirst part of it <tag>, café here.\n\nSecond one with a link and moreover some words.\n\nitem one of the list\n\nitem two of the list\n\nLast words of the text."


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "just text &amp; nothing else"), (5, "u", "<p>open <script>never closed"), (6, "u", "<p>" + "word " * 20000), (1, "u", PAGE), (None, "u", PAGE)]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = html.main_text(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 7 and by[1].text == TEXT and by[1].n_chars == len(TEXT) and by[1].url == "u"
    assert by[2].text == by[3].text == "" and by[4].text == "just text & nothing else" and by[5].text == "open" and by[6].n_chars == 5 * 20000 - 1
    assert html.main_text(pages.limit(0)).count() == 0


BODY = "<p>" + "The first paragraph of the story. " * 4 + "</p><p>And a second one with its own words.</p>"
TAIL = "And these are the last words of it all."
WORDS = [("The first paragraph of the story. " * 4).strip(), "And a second one with its own words."]
ODD = {
    "no head end": (f"<html><head><title>t</title><meta charset=x><body><nav><a>Home</a></nav>{BODY}", WORDS),
    "no head end, no body": (f"<head><title>t</title><link rel=x>{BODY}", WORDS),
    "text ends the head": ("<head><title>t</title>Words that come at once and go on.", ["Words that come at once and go on."]),
    "discussion": (f'<section id="discussion">{BODY}</section>', WORDS),
    "side by side": (f'<p class="side-by-side">Both of them.</p>{BODY}', ["Both of them.", *WORDS]),
    "hidden in a title": (f'{BODY}<p title="a hidden gem">A gem.</p>', [*WORDS, "A gem."]),
    "social sciences": (f'{BODY}<div class="social-sciences">On society.</div><p>{TAIL}</p>', [*WORDS, "On society.", TAIL]),
    "data state": (f'<div data-state="not hidden" data-role="form">{BODY}</div>', WORDS),
    "unclosed button": (f"<button>Play {BODY}", ["Play", *WORDS]),
    "buttons": (f"<button>Play</button>{BODY}<p>Text <button>Copy</button> goes on.</p>", [*WORDS, "Text goes on."]),
    "unclosed quote": (f"<p>See the <a title=\"it's>link</a> there.</p>{BODY}<p class=\"x\">End of it.</p>", ["See the link there.", *WORDS, "End of it."]),
    "markup in a value": (f'<p data-x="<b>no</b> a > b">Yes.</p>{BODY}', ["Yes.", *WORDS]),
    "form around all": (f'<form id="aspnetForm"><nav>Menu here</nav>{BODY}<div class="sidebar">Side words</div></form>', WORDS),
    "sidebar layout": (f'<body class="has-sidebar no-ads"><div id="sidebar-left"><p>Side.</p></div><div class="content-sidebar-wrap">{BODY}</div><div class="widget-area">More.</div>', WORDS),
    "unclosed nav": (f"<nav><a href=x>Home</a> {BODY}", WORDS),
    "shares and adverts": (f'{BODY}<div class="social-share">Share it</div><div class="ad-slot-1">Buy</div><p>After the advert.</p><div id="cookie-notice">We use cookies</div>', [*WORDS, "After the advert."]),
    "comments": (f'<article>{BODY}<section class="comments-area"><article class="comment"><p>{"I like this a lot. " * 3}</p></article></section></article>', WORDS),
    "furniture alone": ("<nav><a href=x>Home</a></nav><footer>All rights</footer>", []),
    "cells without ends": (f"{BODY}<table><tr><td>one<td>two<tr><td>three</table><p>{TAIL}</p>", [*WORDS, "one", "two", "three", TAIL]),
    "unclosed link": (f'{BODY}<p>Go <a href="x">here <a href="y">or there</a> now<script>x</script>.</p><p>{TAIL}</p>', [*WORDS, "Go here or there now.", TAIL]),
}


@pytest.mark.parametrize("name", list(ODD))
def test_odd_pages_keep_their_text(name):
    page, blocks = ODD[name]
    assert html.Page(page).text(html.PRIOR) == "\n\n".join(blocks)


def test_odd_pages_take_time_in_proportion():
    import time

    started = time.time()
    for page in ("<div>" * 60_000 + "x", "</b>" * 60_000, "<p title=\"it's>" * 20_000, "<i>" * 30_000 + "</b>" * 30_000, "<" * 60_000, "<!--" * 20_000):
        html.Page(page).text(html.PRIOR)
    assert time.time() - started < 20


def test_main_text_of_the_pages(spark, sf_dir):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_the_region_is_the_greatest_sum():
    draw = random.Random(8)
    weights = {"word p": 1.0, "word link": -0.5, "tag p": -1.5, "tag block": -3.0}
    for _ in range(200):
        tokens = [(draw.choice(list(weights)), draw.randint(0, 4)) for _ in range(draw.randint(0, 12))]
        score = [weights[k] * (n if k.startswith("word") else 1) for k, n in tokens]
        first, last = html.region(tokens, weights)
        assert sum(score[first:last]) == pytest.approx(max([0.0, *(sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1))]))


def test_ordinal_fit_shares_weights_and_orders_thresholds():
    draw = np.random.default_rng(5)
    x = (draw.random((600, 4)) < 0.4).astype(int)
    grades = np.minimum(3, x[:, 0] * 2 + x[:, 1])
    rows, features = np.nonzero(x)
    weights, cuts = toxicity.fit(rows, features, grades, 4)
    assert (np.diff(cuts) > 0).all() and weights[0] > weights[1] > abs(weights[2])
    values = np.bincount(rows, weights=weights[features], minlength=600)
    expected = toxicity.severity(values, cuts).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.9 and np.mean(np.abs(expected - grades)) < 0.5
    assert toxicity.best_cut(np.array([0.1, 0.2, 2.0, 2.5]), np.array([0, 0, 1, 1])) == pytest.approx(1.1)


def toxic_tables(spark, make_docs, n=300):
    draw = random.Random(9)
    plain = ["".join(draw.choice("abdegilmnoprstu") for _ in range(draw.randint(2, 8))) for _ in range(300)]
    rude = ["idiot", "scum", "loweix", "loweiz", "moron"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        ws = [draw.choice(plain) for _ in range(draw.randint(5, 60))]
        for _ in range(draw.randint(2, 5) if toxic else 0):
            ws.insert(draw.randint(0, len(ws)), draw.choice(rude) + draw.choice(["", ".", ",", "%%%"]))
        rows.append((i, " ".join(ws)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "loweiqq and SCUM, idiot! moron"), (1003, "a plain text"), (1003, "a plain text")]
    labels += [(4, 1, 0), (2, None, None), (None, 1, 1), (99999, 1, 1)]
    return make_docs(rows), spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")


def test_toxicity(spark, make_docs):
    docs, labels = toxic_tables(spark, make_docs)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held_out = [i for i in range(300) if i % 2]
    right = sum(got[i].toxic == (i % 5 == 0) for i in held_out)
    assert right >= 0.95 * len(held_out) and not got[1000].toxic and not got[1001].toxic and got[1002].toxic and not got[1003].toxic
    assert all(0 <= r.severity <= 3 for r in got.values()) and got[1002].severity > got[1003].severity
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}


def test_toxicity_against_a_plain_version(spark, make_docs):
    """Features, their choice, out-of-fold grades and scores of all documents, with sets and loops."""
    from collections import Counter

    import regex

    docs, labels = toxic_tables(spark, make_docs)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text or "")
    known = {}
    for r in labels.collect():
        if r.doc_id in texts and r.toxic is not None:
            known[r.doc_id] = max(known.get(r.doc_id, 0), r.toxic)

    def features(text):
        found = set()
        for piece in regex.findall("[^\x20\x09-\x0d]+", text.lower()):
            for word in regex.findall(r"\p{L}+", piece):
                found |= {word} | {f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n}
        return found

    sample = {texts[i]: t for i, t in sorted(known.items(), reverse=True)}  # of equal texts the least id's label
    totals = Counter(sample.values())
    a, b = Counter(), Counter()
    for text, t in sample.items():
        (a if t else b).update(features(text))
    odds = {f: (a[f] + 0.5) / (b[f] + 0.5) * (totals[0] + 1) / (totals[1] + 1) for f in a}
    names = sorted((f for f in a if a[f] >= toxicity.LEAST_TEXTS and odds[f] >= toxicity.LEAST_ODDS), key=lambda f: (-a[f] * math.log(odds[f]), f))
    rows = sorted(([names.index(f) for f in sorted(features(text) & set(names), key=names.index)], t) for text, t in sample.items())
    rows.sort(key=lambda r: f"{r[0]} {r[1]}")
    toxic = np.array([t for _, t in rows])
    row, feature = np.array([(i, f) for i, (fs, _) in enumerate(rows) for f in fs]).T
    score = np.zeros(len(rows))
    for k in range(toxicity.FOLDS):
        others = [i for i in range(len(rows)) if i % toxicity.FOLDS != k]
        pairs = np.array([(n, f) for n, i in enumerate(others) for f in rows[i][0]]).T
        weights, _ = toxicity.fit(pairs[0], pairs[1], toxic[others], len(names), toxicity.FOLD_STEPS, top=1)
        for i in range(k, len(rows), toxicity.FOLDS):
            score[i] = sum(weights[f] for f in rows[i][0])
    low, high = np.quantile(score[toxic == 1], [1 / 3, 2 / 3])
    grades = np.array([0 if not t else 1 + (s > low) + (s > high) for t, s in zip(toxic, score)])
    weights, cuts = toxicity.fit(row, feature, grades, len(names))
    severity = lambda fs: sum(1 / (1 + math.exp(c - sum(weights[f] for f in fs))) for c in cuts)
    least = toxicity.best_cut(np.array([severity(fs) for fs, _ in rows]), toxic)
    assert len(set(grades)) == 4
    for r in toxicity.toxicity(docs, labels).collect():
        value = severity([names.index(f) for f in features(texts[r.doc_id]) if f in names])
        assert r.severity == pytest.approx(value, abs=1e-4) and r.toxic == (value >= least), r.doc_id


def test_toxicity_without_labels(spark, make_docs):
    docs, labels = toxic_tables(spark, make_docs, 20)
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert {(r.severity, r.toxic) for r in toxicity.toxicity(docs, none).collect()} == {(0.0, False)}
        assert toxicity.without_toxic(docs, none).count() == docs.count()
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def plain_top(rows, is_query, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    scored = {}
    for q, v in good:
        if is_query(q):
            scored.setdefault(q, []).extend((-sum(a * b for a, b in zip(v, w)), c) for c, w in good if c != q)
    return sorted((q, n + 1, c, max(-(1 << 63), min((1 << 63) - 1, -s))) for q, pairs in scored.items() for n, (s, c) in enumerate(sorted(pairs)[:k]))


@pytest.mark.parametrize("groups", [(8192, 4096), (16, 3)])
def test_exact_top_k(spark, monkeypatch, groups):
    monkeypatch.setattr(topk, "CANDIDATES", groups[0])
    monkeypatch.setattr(topk, "QUERIES", groups[1])
    draw = np.random.default_rng(7)
    rows = [(i, draw.normal(0, 0.2, 20).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(300, None), (301, [float("nan")] * 20), (302, [float("inf")] * 20), (303, [None] * 20), (304, [0.5, 0.5]), (305, []), (None, rows[1][1]), (0, rows[0][1])]
    rows += [(5, [0.9] * 20), (5, [0.1] * 20), (5, [0.9] * 20), (10, [0.7] * 20)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = topk.exact_top_k(table, lambda i: i % 10 == 0, k=5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == plain_top(rows, lambda i: i % 10 == 0, 5)
    large = rows[:30] + [(400, [1e12] * 20), (401, [-3e30, 1.0]), (410, [7e11] * 20)]
    got = topk.exact_top_k(spark.createDataFrame([(*r, "x") for r in large], "vec_id long, embedding array<float>, score string"), lambda i: i % 10 == 0, k=5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == plain_top(large, lambda i: i % 10 == 0, 5)
    few = topk.exact_top_k(table.where("vec_id < 3"), lambda i: i % 10 == 0, k=5)
    assert few.count() == 4 and topk.exact_top_k(table.limit(0), lambda i: i % 10 == 0).count() == 0
    assert topk.exact_top_k(table.where(F.col("vec_id") == 0), lambda i: i % 10 == 0).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from quoteverify.llm import common

    from .test_text_operators import plain_ids, plain_leaks, plain_removed, plain_similar

    docs = common.documents(spark, sf_dir)
    columns, stages = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "test")
        stages.append([r.asDict() for r in docs.collect()])
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    clean, distinct, cut, safe, packed = stages
    flags = {r.doc_id: r.toxic for r in toxicity.toxicity(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels")).collect()}
    assert sorted(r["doc_id"] for r in clean) == sorted(i for i, t in flags.items() if not t)
    groups = plain_similar([(r["doc_id"], r["text"]) for r in clean])
    assert sorted(r["doc_id"] for r in distinct) == sorted(min(i for i, _ in g) for g in groups.values()) and len(distinct) < len(clean)
    texts = {i: " ".join(w for w, g in zip(ws, gone) if not g) for i, ws, gone in plain_removed([(r["doc_id"], r["text"]) for r in distinct]) if any(gone)}
    assert {r["doc_id"]: r["text"] for r in cut} == {r["doc_id"]: texts.get(r["doc_id"], r["text"]) for r in distinct}
    items = [(r.item_id, r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    leaked = plain_leaks([(r["doc_id"], r["text"]) for r in cut], items)
    assert leaked and sorted(r["doc_id"] for r in safe) == sorted(r["doc_id"] for r in cut if r["doc_id"] not in leaked)
    lengths = {}
    for r in packed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {i: len(ids) for i, ids in plain_ids("word_bpe_49k.json", [(r["doc_id"], r["text"]) for r in safe], 1)}


def test_queries_are_registered():
    from quoteverify.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
