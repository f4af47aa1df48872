"""Token counts, license scans and HTML extraction against slow versions and written cases."""

import html as html_lib
import math
import random
import re
import time

import pytest
import regex
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from turnstile.llm import html_text, licenses, packing, token_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " ", "\n", "a", "a  b", "x" * 5000, "é ü", "the the the", "日本語 text", "\U0001f600" * 40]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def scores():
    return token_counts.read_scores(token_counts.vocabulary_path())


def pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


def best_pieces(word, scores):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        starts = [s for s in range(max(0, end - 130), end) if word[s:end] in scores]
        top = max((best[s][0] + scores[word[s:end]], -best[s][1] - 1) for s in starts)
        best[end] = (top[0], -top[1])
    return best[-1][1]


def test_token_counts_match_brute_force(spark, scores):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text")
    frame = docs(spark, ODD).select("doc_id", "text").unionAll(table.withColumn("doc_id", F.col("doc_id") + 1000))
    frame = frame.withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.token_counts(frame).collect()}
    known = {}
    for r in frame.collect():
        found = regex.findall(pattern(), r["text"] or "")
        for word in set(found) - known.keys():
            known[word] = best_pieces(word.encode(), scores)
        assert got[r["doc_id"]] == (len(found), sum(known[w] for w in found))
    assert token_counts.token_counts(frame.where("doc_id < 0")).count() == 0


def test_a_full_trie_starts_anew(scores):
    small, large = token_counts.Trie(scores, max_nodes=20), token_counts.Trie(scores)
    words = [f"prefix{i}suffix".encode() for i in range(50)] * 2
    assert [small.count(w) for w in words] == [large.count(w) for w in words] == [large._count_alone(w) for w in words]
    assert len(small.nodes) < 60


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.ranks_path(), pattern())


def ids(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def test_ids_of_every_character_are_the_tokenizers(tokenizer, encoder):
    for first in range(0, 0x30000, 64):
        block = [chr(c) for c in range(first, first + 64) if not 0xD800 <= c <= 0xDFFF]
        text = "".join(f"a{c} {c}1{c}{c}  {c}\n{c}" for c in block)
        assert ids(encoder.encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.text(st.sampled_from(" \t\n\r  a'sX9é|<>endoftx") | st.characters(codec="utf-8"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _both
    if "_both" not in globals():
        file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        _both = (packing.Encoder(packing.ranks_path(), pattern()), file)
    for t in (text, text + "<|endoftext|>" + text):
        assert ids(_both[0].encode(t)) == _both[1].encode(t, add_special_tokens=False).ids


def slow_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        wanted = phrase.decode().split()
        for i in range(len(words)):
            if words[i : i + len(wanted)] == wanted:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


CASES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "All rights reserved.": "all-rights-reserved",
    "SPDX-License-Identifier: MPL-2.0": "mpl",
    "under the GNU Lesser General Public License v2.1 or later": "gpl,lgpl-2.1",
    "the BSD 3-Clause License": "bsd-3-clause",
    "an apache of the license": "",
    "mit license mit license apache license": "apache,mit",
}


def test_license_cases():
    scanner = licenses.Scanner()
    assert 300 < len(scanner.rules) < 1000
    for text, labels in CASES.items():
        found = scanner.scan(text)
        assert found["labels"] == labels, text
        assert 0 <= found["score"] <= 1 and (found["score"] > 0) == bool(labels)


def test_every_rule_needs_its_keyword_and_suppression_matches_brute_force():
    """Each rule run without the prefilter gives the same; kept intervals are those not within a better one."""
    scanner = licenses.Scanner()
    texts = list(CASES) + ["permission is hereby granted free of charge to any person obtaining a copy " + t for t in CASES]
    texts.append(" ; ".join(CASES) * 3)
    for text in texts:
        joined = b" ".join(licenses.words_of(text))
        found = scanner.matches(joined)
        every = [(m.start(), m.end(), r) for r in scanner.rules for m in r.pattern.finditer(joined)]
        key = lambda m: (m[0], m[1], m[2].place)
        assert sorted(map(key, found)) == sorted(map(key, every))
        order = lambda m: (-m[2].priority, -(m[1] - m[0]), m[2].place, m[0])
        slow = []
        for m in sorted(every, key=order):
            if not any(a <= m[0] and m[1] <= b for a, b, _ in slow):
                slow.append(m)
        assert sorted(map(key, licenses.suppress(found))) == sorted(map(key, slow))


def test_scan_matches_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    texts = ODD + list(CASES) + [r["text"] for r in table] + ["MIT\x00License\x7fmit license é" * 3, "mit license " * 2000]
    frame = docs(spark, texts).withColumn("labels", F.lit(1))
    for r in licenses.scan_licenses(frame).collect():
        expected = slow_scan(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == expected
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert licenses.scan_licenses(frame.where("doc_id < 0")).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="ad">Buy &amp; buy.</div><script>var t="</p>";</script>%s
<aside>Related</aside><div id="comments"><p>First! %s</p></div><form><label>Mail</label><input></form>
<footer>&copy; site</footer></body></html>"""
LONG = "A sentence that is long enough to look like text. " * 5


def test_html_regions():
    article = f"<article><h1>Head &lt;1&gt;</h1><p>{LONG}\n\t<b>bold</b>text<br>next<p>Short.<ul><li>One<li>Two</ul></article>"
    blocks = ["Head <1>", f"{LONG}boldtext next", "Short.", "One", "Two"]
    assert html_text.main_text(PAGE % (article, LONG)) == "\n\n".join(blocks)
    bare = f"<div id='content'><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>"
    assert html_text.main_text(PAGE % (bare, LONG)) == "\n\n".join(["Head", LONG.strip(), "Short.", LONG.strip()])
    for page in (None, "", "<html></html>", "<script>x", "<!-- c -->", "<nav>menu</nav>"):
        assert html_text.main_text(page) == ""
    assert html_text.main_text("just &eacute; text") == "just é text"
    assert html_text.main_text("<article><p>Tiny.</p></article>") == "Tiny."
    assert html_text.main_text("<p>" * 3000 + "deep") == "deep"


def paragraphs(n, text=LONG):
    return "".join(f"<p>{i} {text}</p>" for i in range(n))


def blocks_of(n, text=LONG):
    return [f"{i} {text}".strip() for i in range(n)]


CARD = "<article><h3>Another headline here</h3><p>" + "A teaser of some words. " * 6 + "</p></article>"
REGIONS = {
    "cards after a text in a div": (f"<div>{paragraphs(6)}</div>{CARD * 3}", blocks_of(6)),
    "cards within the text's div": (f"<div>{paragraphs(6)}{CARD * 3}</div>", blocks_of(6)),
    "cards after an article": (f"<article>{paragraphs(6)}</article>{CARD * 3}", blocks_of(6)),
    "two articles of like size": (f"<article>{paragraphs(3)}</article><article>{paragraphs(2)}</article>", blocks_of(3) + blocks_of(2)),
    "a layout's class on the text": (f'<div class="content sidebar-right">{paragraphs(4)}</div>', blocks_of(4)),
    "a form around the page": (f"<form id=aspnet><div>{paragraphs(4)}</div><input></form>", blocks_of(4)),
    "short paragraphs after long ones": (f"<div>{paragraphs(3)}{paragraphs(6, 'Short.')}</div>", blocks_of(3) + blocks_of(6, "Short.")),
    "short paragraphs before long ones": (f"<div>{paragraphs(4, 'Short.')}{paragraphs(3)}</div>", blocks_of(4, "Short.") + blocks_of(3)),
    "words that only look like hints": (
        f'<article>{paragraphs(2)}<p class="share-price">Up 3.</p><div class="ad-free">No adverts.</div></article>',
        blocks_of(2) + ["Up 3.", "No adverts."],
    ),
    "hints with words beside them": (
        f'<article>{paragraphs(2)}<div class="share-buttons">Tweet</div><div id="post-comments">{paragraphs(9)}</div></article>',
        blocks_of(2),
    ),
    "a heading before the text": (f"<div><h1>Head</h1><div>{paragraphs(3)}</div></div><div>&copy; all of us</div>", ["Head"] + blocks_of(3)),
    "a small side bar": (f'<div>{paragraphs(3)}</div><div class="sidebar">{paragraphs(1)}</div>', blocks_of(3)),
    "paragraphs in divs of their own": ("".join(f"<div>{x}</div>" for x in blocks_of(5)), blocks_of(5)),
    "an unclosed comment": (f"<div>{paragraphs(2)}<!-- {paragraphs(1)}</div>", blocks_of(2) + blocks_of(1)),
    "conditional markup": (f"<![if IE]><div>{paragraphs(2)}</div><![endif]>", blocks_of(2)),
    "a page that ends in a tag": (f"<div>{paragraphs(2)}</div><a href='x", blocks_of(2)),
}


@pytest.mark.parametrize("name", REGIONS)
def test_html_pages_of_all_kinds(name):
    body, expected = REGIONS[name]
    got = html_text.main_text(f"<html><body><nav>Menu</nav>{body}<footer>Foot</footer></body></html>")
    assert got.split("\n\n")[: len(expected)] == expected
    assert len(got.split("\n\n")) == len(expected) or name == "a page that ends in a tag"


@pytest.mark.parametrize(
    "page", ["<b></i>" * 100_000, "<!--" * 100_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<p>" + "<b>" * 50_000 + "<li>" * 50_000,
             "<a " * 100_000, "<div>" * 50_000, "<?" * 100_000, "<div class=sidebar>" * 5_000 + "x" + "</p>" * 50_000]
)
def test_html_work_grows_with_length(page):
    began = time.process_time()
    html_text.main_text(page + "<p>end")
    assert time.process_time() - began < 10


def slow_region(lines):
    """The rule on usable lines again, by definition: a container's lines are looked up by every pair."""
    total = sum(len(x.text) for x in lines if not x.always)
    wraps = lambda e: 2 * sum(len(x.text) for x in lines if not x.always and e in x.layout) > total
    usable = [i for i, x in enumerate(lines) if x.text and not x.always and all(map(wraps, x.layout))]
    ratio = [len(x.text) / max(1, x.tags) if i in usable else 0.0 for i, x in enumerate(lines)]
    weight = [math.exp(-(k**2) / 8) for k in range(-2, 3)]
    level = [sum(w * ratio[i + k] for k, w in zip(range(-2, 3), weight) if 0 <= i + k < len(lines)) / sum(weight) for i in range(len(lines))]
    mean = sum(ratio) / len(ratio)
    above = [i for i in usable if level[i] > 0.5 * math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))] or usable
    size = {a: sum(len(lines[i].text) for i in above if lines[i].article == a) for a in {lines[i].article for i in above}}
    best = max(size, key=lambda a: (size[a], a))
    if best >= 0:
        return [lines[i].text for i in usable if lines[i].article >= 0 and 3 * size.get(lines[i].article, 0) >= size[best]]
    inner = [c for c in {c for x in lines for c in x.containers}
             if sum(len(lines[i].text) for i in above if lines[i].article < 0 and c in lines[i].containers) >= 0.8 * size[-1]]
    inside = [i for i, x in enumerate(lines) if x.article < 0 and (not inner or max(inner) in x.containers)]
    first = inside[0]
    while first and (not lines[first - 1].text or first - 1 in usable and lines[first - 1].heading and lines[first - 1].article < 0):
        first -= 1
        inside.append(first)
    return [lines[i].text for i in usable if i in inside]


def test_html_region_matches_a_slow_twin():
    rng = random.Random(6)
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 25)):
            words = "word " * rng.choice([0, 1, 3, 30, 90])
            tag = rng.choice(["p", "p", "p", "li", "div", "h2", "section", "article", "form", 'div class="sidebar"', 'div class="ad"', "nav"])
            parts.append(f"<{tag}>{words}" + (f"</{tag.split()[0]}>" if rng.random() < 0.7 else ""))
        page = "".join(parts)
        lines = html_text.Lines().read(page)
        usable = html_text.main_text(page)
        assert usable == ("\n\n".join(slow_region(lines)) if usable else "")


def test_html_on_driver_pages(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet").withColumn("text", F.lit("clash"))
    found = {r["page_id"]: r for r in html_text.extract_text(table).collect()}
    assert html_text.extract_text(table.where("page_id < 0")).count() == 0
    for r in table.collect():
        blocks = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        plain = (" ".join(html_lib.unescape(re.sub("<br>", " ", b).replace("<b>", "")).split()) for b in blocks)
        expected = "\n\n".join(filter(None, plain))
        got = found[r["page_id"]]
        assert (got["text"], got["n_chars"], got["url"]) == (expected, len(expected), r["url"])
