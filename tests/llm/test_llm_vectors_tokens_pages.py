"""Whitening, cross-tokenizer alignment and main text against brute-force versions, over ordinary and odd rows."""

from __future__ import annotations

import hashlib
import html
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from furrow.llm import alignment, bpe, html_text, whitening
from tokenizers import Tokenizer

# 11


def brute_whitening(rows):
    """(n, deviations by row, whitened up to signs, shares) by Python integers and one dense matrix."""
    good = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted(set(map(tuple, good)))
    n, d = len(fit), len(good[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    e, p = np.linalg.eigh(centred.T @ centred / n)
    e, p = e[::-1][:16], p[:, ::-1][:, :16]
    spread = [[n * c - s for c, s in zip(v, sums)] for v in good]
    white = np.array([[x / n for x in v] for v in spread]) @ p / np.sqrt(e)
    return n, [sum(x * x for x in v) for v in spread], white, e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("width", [5, 40])
def test_whitening(spark, width):
    rng = np.random.default_rng(width)
    base = (rng.normal(size=(400, width)) * np.linspace(0.2, 3, width)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(None, rows[8][1])] * 2  # a hot vector counts once
    odd = [(2000, None), (2001, [None, *rows[0][1][1:]]), (2002, [float("nan"), *rows[0][1][1:]]), (2003, [float("-inf"), *rows[0][1][1:]]), (2004, [])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, x string, component int").repartition(5)
    got = whitening.whiten(table).collect()
    n, deviations, white, shares = brute_whitening(rows)
    k = min(width, 16)
    assert len(got) == len(rows) * k and {r.n for r in got} == {n}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(k):
        sign = np.sign(by[0, c + 1].whitened * white[0, c])
        for at, (i, _) in enumerate(rows):
            r = by[i, c + 1]
            assert abs(sign * r.whitened - white[at, c]) < 1e-8
            assert r.deviation == deviations[at]
            assert abs(r.explained / shares[c] - 1) < 1e-9


def test_whitening_of_odd_tables(spark):
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert of([]) == of([(1, []), (2, None)]) == of([(1, [1.0, 2.0])] * 3) == []
    got = of([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0]), (4, [1e30, 2.0])])  # a constant dimension, another length, no long
    assert [(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got] == [(1, 1, 2, 64**2, 1.0, 1.0), (2, 1, 2, 64**2, 1.0, 1.0)]
    wide = of([(1, [0.0, 2e15]), (2, [0.0, 3.0]), (3, [0.0, 5e14])])  # exact, though the squares are beyond a long
    assert {r.deviation for r in wide} == {None} and max(r.identity_error for r in wide) < 1e-9


# 12


def brute_alignment(rows):
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    byte = {c: x for x, c in bpe.byte_letters().items()}
    docs, count = [], Counter()
    for i, text in rows:
        links, groups, ids = [], [], ([], [])
        own = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ids
        raw = [[bytes(byte[c] for c in a.id_to_token(t)) for t in own[0]], [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in own[1]]]
        if text and b"".join(raw[0]) == f" {text}".encode() == b"".join(raw[1]):
            ids = own
            ends = [np.cumsum([len(t) for t in side]).tolist() for side in raw]
            at = [0, 0]
            for common in sorted(set(ends[0]) & set(ends[1])):
                parts = []
                for side in (0, 1):
                    first = at[side]
                    while at[side] < len(ids[side]) and ends[side][at[side]] <= common:
                        at[side] += 1
                    parts.append(range(first, at[side]))
                groups.append("|".join(",".join(str(ids[s][x]) for x in parts[s]) for s in (0, 1)))
                links += [(ids[0][x], ids[1][y]) for x in parts[0] for y in parts[1] if max(ends[0][x] - len(raw[0][x]), ends[1][y] - len(raw[1][y])) < min(ends[0][x], ends[1][y])]
        count.update(links)
        docs.append((i, len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(((i, x, y, g, len(p), sum(count[q] == best[q[1]] for q in p), sum(count[q] for q in p), h) for i, x, y, g, p, h in docs), key=str)


@pytest.mark.parametrize(("heavy", "run"), [(alignment.HEAVY, alignment.RUN), (40, 50), (1, 7)])
def test_alignment(spark, sf_dir, heavy, run, monkeypatch):
    """Also with few pairs broadcast, and with runs so short that most groups lie in several."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").orderBy("doc_id").limit(60).collect()]
    texts += [None, "", "x", " ", "\n\n\t ", "  a   b  ", "▁x a", "<|endoftext|> <s> a </s>", "é" * 500, "x" * 700, "  " * 300, "a\x00b", "日本語テキスト " * 30, "👨‍👩‍👧 😀" * 20, "Åﬁ ＡＢ", "xyz" * 900, "a b " * 300]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (None, "a b"), (3, texts[0]), (3, texts[0])]
    table = spark.createDataFrame([(i, t, "k", 1, b"") for i, t in rows], "doc_id long, text string, _key string, run int, ids binary").repartition(4)
    monkeypatch.setattr(alignment.events, "__defaults__", (run, *alignment.events.__defaults__[1:]))
    monkeypatch.setattr(alignment.links, "__defaults__", (400,))  # a few runs a step
    assert sorted((tuple(r) for r in alignment.align(table, heavy=heavy).collect()), key=str) == brute_alignment(rows)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# 13

LONG = "The river runs through the town and it is one of the oldest in the country, as the people who live there will tell you when they are asked about it. It was named for a king who came here."
OTHER = "Это длинный абзац текста про город и людей которые там живут уже много лет " * 5
PAGES = {
    "plain": (f"<html><body><div class='menu'><a href=x>Home</a> <a href=y>About</a></div><div><h1>The title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div>Copyright 2020 all rights</div></body></html>", f"The title {LONG} Short one. {LONG}"),
    "main": (f"<body><header><p>Site name</p></header><main><h1>T</h1><p>{LONG}</p><aside><p>{LONG}</p></aside><form><label>Name</label><input></form><section id=comments><article class=comment><p>{LONG}</p></article></section></main><footer>x</footer>", f"T {LONG}"),
    "notices": (f"<body><div id='cookie-notice'>{LONG} We use cookies <button>OK</button></div><article><header><h1>T</h1></header><p>{LONG}<div class='ad-box'>{LONG}</div><p>End.<ul class=share><li><a href=1>Tweet</a></ul><footer>{LONG}</footer></article><div class=related><article class=teaser>{LONG}</article></div>", f"T {LONG} End."),
    "references": ("<article><p>a&nbsp;&lt;b&gt; &amp;amp; &#x41;&#66; caf&eacute; x<b>y</b>z 1 < 2 <!-- c -->q<br>r</p></article>", "a <b> &amp; AB café xyz 1 < 2 q r"),
    "scripts": ("<article><p>a</p><script>if (a<b) document.write('</p><p>no')</script><style>p{}</style><p>b</p><noscript>no</noscript></article>", "a b"),
    "attributes": ("<article><p title=\"a > b\" data-x='<p>'>ok</p></article>", "ok"),
    "unclosed": (f"<body><nav><ul><li><a href=1>x</a><article><p>{LONG}<p>Two</article>", f"{LONG} Two"),
    "table": ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
    "another language": (f"<body><div><a href=/>Главная</a></div><p>{OTHER}</p></body>", OTHER.strip()),
    "capitals": (f"<ARTICLE><H1>T</H1><P CLASS=x>{LONG}</P></ARTICLE>", f"T {LONG}"),
    "links in prose": (f"<article><p>{LONG} <span class='ad'>Buy now</span>tail <a href=x>a link</a></p><p><a href=y>Only a link</a></p><ul><li><a href=1>More of this</a></li></ul></article>", f"{LONG} tail a link Only a link"),
    "empty": ("", ""),
    "no text": ("<p></p>", ""),
    "title before": (f"<h1>T</h1><article><p>{LONG}</p></article><p>{LONG}</p>", f"T {LONG}"),
}


def test_main_text(spark):
    rows = [(i, k, h) for i, (k, (h, _)) in enumerate(PAGES.items())] + [(None, None, None), (1, "twice", "<article>x y</article>"), (1, "twice", "<article>x y</article>")]
    table = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = sorted((r.url or "", r.text, r.n_chars) for r in html_text.extract(table).collect())
    want = [(k, t) for k, (_, t) in PAGES.items()] + [("", ""), ("twice", "x y"), ("twice", "x y")]
    assert got == sorted((k, t, len(t)) for k, t in want)
    assert html_text.extract(table.limit(0)).collect() == []


def test_main_text_of_the_table(spark, sf_dir):
    """Its pages have one layout, so that one pattern finds what stands in their articles."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows)).collect()}
    for r in rows:
        inner = re.search("<article>(.*)</article>", r.html, re.DOTALL)[1]
        assert found[r.page_id] == " ".join(html.unescape(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())


@pytest.mark.parametrize("page", ["<" * 200_000, '<a href="' * 60_000, "<!--" * 60_000, "<p>" * 60_000, "<a " + "x " * 200_000, "<a " + "=" * 200_000 + ">", "<ul><li>" * 30_000, "<script>" * 60_000, "</div>" * 60_000, "<div>" * 60_000, "<svg>x" * 10_000, "&" * 200_000, "<p>" + "<b>" * 60_000 + "<p>x"])
def test_malformed_pages_take_no_longer(page):
    begin = time.time()
    html_text.blocks_of(page)
    assert time.time() - begin < 20
