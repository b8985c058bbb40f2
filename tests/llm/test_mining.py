"""Whitening, phrases and page texts against plain versions, planted cases and awkward rows."""

import html as htmllib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import pages, phrases, queries, whitening

# ---------------------------------------------------------------- whitening


def plain_whitening(rows, components=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = np.array([[float(n * int(c) - int(t)) / n for c, t in zip(row, s, strict=True)] for row in x])
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    return n, deviation, (centred @ axes / np.sqrt(e))[:, :components], (e / e.sum())[:components]


def test_whitening_equals_plain_version(spark, sf):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = defaultdict(dict)
    for r in queries.op11_whitening(spark, sf).collect():
        got[r["vec_id"]][r["component"]] = r
    n, deviation, white, explained = plain_whitening(list(rows.values()))
    assert set(got) == set(rows) and all(set(g) == set(range(1, 33)) for g in got.values())
    mine = np.array([[got[i][k]["whitened"] for k in range(1, 33)] for i in rows])
    sign = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine, white * sign, atol=1e-8)
    assert np.allclose([got[0][k]["explained"] for k in range(1, 33)], explained, rtol=1e-9)
    assert [got[i][1]["deviation"] for i in rows] == deviation
    assert {r["n"] for g in got.values() for r in g.values()} == {n}
    (error,) = {r["identity_error"] for g in got.values() for r in g.values()}
    assert error < 1e-9


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [3.0, -1.0], 0), (2, None, 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [None, 1.0], 0), (6, [], 0), (7, [5.0], 0), (8, [0.0, 0.5], 0), (9, [1e300, 1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long")
    got = {(r["vec_id"], len(r["whitened"])): r for r in whitening.whiten(df).collect()}
    assert set(got) == {(1, 2), (None, 2), (6, 0), (7, 1), (8, 2), (9, 3)}
    n, deviation, white, _ = plain_whitening([[1.0, 2.0], [1.0, 2.0], [3.0, -1.0], [0.0, 0.5]])
    assert got[1, 2]["n"] == 4 and got[8, 2]["deviation"] == deviation[3]
    assert np.allclose(np.abs(got[8, 2]["whitened"]), np.abs(white[3]))
    assert got[7, 1]["whitened"] == [None] and got[7, 1]["explained"] == [None] and got[7, 1]["identity_error"] is None
    assert got[9, 3]["deviation"] == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(df, most=2)


def test_whitening_does_not_depend_on_the_parts_and_stays_exact(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(0, 3, (500, 6)) * [1, 2, 3, 4, 5, 0]  # the last component is constant
    m[0, 0] = 1e6  # whole numbers whose squares pass 64 bits
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    n, deviation, _, _ = plain_whitening(m)
    for parts in (1, 7):
        got = whitening.whiten(df.repartition(parts)).orderBy("vec_id").collect()
        assert [int(r["deviation"]) for r in got] == deviation
        assert got[0]["whitened"][5] is None and got[0]["explained"][5] == 0.0
        white = np.array([r["whitened"][:5] for r in got])
        assert np.allclose(np.cov(white.T, bias=True), np.eye(5), atol=1e-6)


# ---------------------------------------------------------------- phrases


def plain_phrases(rows, least=10, share=50, top=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = defaultdict(list)
    frequent = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    longer = defaultdict(int)
    for (lang, *p), a in frequent.items():
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                longer[lang, *q] = max(longer[lang, *q], a)
    for (lang, *p), a in frequent.items():
        if 100 * longer[lang, *p] >= share * a and (lang, *p) in longer and longer[lang, *p]:
            continue
        cuts = [(1000000 * a * a // (counts[lang, *p[:k]] * counts[lang, *p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(p).encode(), counts[lang, *p[:k]], counts[lang, *p[k:]]))
    out = []
    for lang, own in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def check_phrases(spark, rows, **how):
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1L as rank", "'x' as phrase")
    got = sorted(tuple(r) for r in phrases.collocations(df, **how).collect())
    assert got == plain_phrases(rows, **how)
    return got


def test_phrases_of_awkward_rows(spark):
    rows = [("New York is Big. new york IS\tbig,new york", "en")] * 4 + [(None, "en"), ("", None), (" \t.,\n", "fr"), ("a a a a a a", None), ("élan Vital élan vital\x0bélan vital", "fr"), ("É É É É", "und"), ("new york", None), ("x", "en")]
    got = check_phrases(spark, rows, least=4)
    assert ("en", "new york is big") not in {(r[0], r[2]) for r in got} and {"en", "und"} <= {r[0] for r in got}
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0


def test_phrases_over_shards_and_ranks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vocabulary = [f"W{i}" for i in range(12)]
    texts = [("".join(str(w) + str(rng.choice([" ", "  ", "\t", ". "], p=[0.7, 0.1, 0.1, 0.1])) for w in rng.choice(vocabulary, 60)), "en" if i % 3 else "fr") for i in range(60)]
    texts.append((" ".join(map(str, rng.choice(vocabulary, 40000))), "en"))  # one long piece
    got = check_phrases(spark, texts, top=50)
    assert len([r for r in got if r[0] == "en"]) == 50
    # small shards, cut inside a text where a piece ends
    names = ("SHARD", "_RUN", "_PAIRS")
    before = [getattr(phrases, n) for n in names]
    for name, value in zip(names, (500, 700, 300), strict=True):
        monkeypatch.setattr(phrases, name, value)
    cut = list(phrases.split(pa.array([t for t, _ in texts])))
    assert sum(len(w) for w, _, _ in cut) == sum(len(re.findall(r"[^ \t\n.]+", t)) for t, _ in texts) and len(cut) > 20
    shard = phrases._Shard(_table(texts))
    for name, value in zip(names, before, strict=True):
        monkeypatch.setattr(phrases, name, value)
    pairs = Counter()
    for one, two, _, bits in shard.extend(shard.word, shard.block, shard.bits):
        for a, b, f in zip(*shard.count(one, two, bits), strict=True):
            pairs[a, b] += f
    assert sum(pairs.values()) == sum(max(0, len(p.split()) - 1) for t, _ in texts[:30] for p in t.split("."))


def _table(texts):
    parts = []
    for words, piece, owner in phrases.split(pa.array([t for t, _ in texts[:30]])):
        parts.append((words, piece, pa.array([texts[o][1] for o in owner])))
    batch = phrases._bitmaps(parts, 0)
    return pa.table({"id": pa.array(range(batch.num_rows)), "gaps": batch.column("gaps"), "bits": batch.column("bits")})


def test_packing_is_reversible():
    gaps = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) + 5, 3])
    assert (phrases.unpack(phrases.pack(gaps)[0]) == gaps).all()
    assert len(phrases.unpack(np.zeros(0, np.uint8))) == 0


# ---------------------------------------------------------------- pages


def marked_up(page):
    """What the article element of the made pages says, by patterns."""
    article = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
    lines = (" ".join(htmllib.unescape(re.sub("<[^>]*>", "", part)).split()) for part in re.split("</?(?:p|h1)>", article))
    return "\n".join(line for line in lines if line)


def test_page_texts_equal_the_articles(spark, sf):
    made = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op13_page_text(spark, sf).collect()
    assert len(got) == len(made)
    for r in got:
        assert r["text"] == marked_up(made[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == made[r["page_id"]]["url"]


PROSE = [f"Sentence number {i} of the story tells at some length what happened on day {i}, and why." for i in range(12)]
LINKS = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(15))
AROUND = """<!DOCTYPE html><html><head><title>Site</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body class="with-sidebar">
<header><h2>My Site</h2><p>The best site for all your daily stories and more, every day.</p></header><nav><ul>{links}</ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site better for you and for all others who come here.</p></div>
{main}
<div id="sidebar"><p>Elsewhere: a long teaser text that has nothing to do with the story, told in many words.</p></div>
<section class="comments"><h3>Comments</h3><p>I liked this story very much, it reminded me of my own summer days.</p></section>
<form action="/s"><p>Leave your address and we will send you more stories like this one each week.</p><input></form>
<div class="ad-slot">Buy this thing now, it is the best thing that you have ever bought.</div>
<footer>Copyright by us, all rights reserved, do not copy.</footer></body></html>"""
PLAIN = "\n".join(["The Story", *PROSE])
CASES = {
    "div": ('<div id="c"><h1>The Story</h1>' + "".join(f"<p>{p}</p>" for p in PROSE) + "</div>", PLAIN),
    "unclosed": ('<div id="c"><h1>The Story</h1>' + "".join(f"<p>{p}\n" for p in PROSE) + "</div>", PLAIN),
    "sections": ("<article><h1>The Story</h1>" + "".join(f"<section><p>{a}<p>{b}</section>" for a, b in zip(PROSE[::2], PROSE[1::2], strict=True)) + "</article>", PLAIN),
    "bare sections": ('<div><h1>The Story</h1><div>' + "".join(f"<p>{p}</p>" for p in PROSE[:7]) + "</div><div>" + "".join(f"<p>{p}</p>" for p in PROSE[7:]) + "</div></div>", "\n".join(PROSE)),
    "article header": ('<article class="post"><header class="entry-header"><h1>The Story</h1></header>' + "".join(f"<p>{p}</p>" for p in PROSE) + '<article class="comment"><p>Me too, I was there as well that day.</p></article><footer>by me</footer></article>', PLAIN),
    "form around": ('<form id="aspnet"><main><article><h1>The Story</h1>' + "".join(f"<p>{p}</p>" for p in PROSE) + "</article></main></form>", PLAIN),
    "inline": ("<article><p>a&nbsp;&lt;b&gt; &amp;c\n <b>d</b><i>e</i><br>f<ul><li>one<li>two</ul>tail</article>", "a <b> &c de f\none\ntwo\ntail"),
    "table": ("<article><table><tr><td>one<td>two</table><pre>x\n  y</pre></article>", "one\ntwo\nx y"),
    "short": ("<article><h1>Be.</h1></article>", "Be."),
}


@pytest.mark.parametrize("name", CASES)
def test_page_layouts(name):
    main, want = CASES[name]
    got = pages.main_text(AROUND.format(links=LINKS, main=main))
    if name == "bare sections":  # a bare heading may stay or go; the text does not
        got = got.removeprefix("The Story\n")
    assert got == want


def test_awkward_pages(spark):
    deep = "<div>" * 20000 + "deep text" + "</div>" * 20000
    rows = [(1, "u", None), (2, None, ""), (None, "u", "no markup at all"), (3, "u", "<p>x"), (3, "u", "<p>x"), (4, "u", deep), (5, "u", "<nav>only</nav>"), (6, "u", "<!-- <p>x</p> --><title>t"), (7, "u", "<p>" + "long text " * 100000), (8, "u", "</div></p><b>bold</b>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 as text", "1 as n_chars")
    got = [(r["page_id"], r["text"]) for r in pages.extract(df).collect()]
    assert got == [(1, ""), (2, ""), (None, "no markup at all"), (3, "x"), (3, "x"), (4, "deep text"), (5, ""), (6, ""), (7, ("long text " * 100000).strip()), (8, "bold")]
    assert pages.extract(df.limit(0)).count() == 0
