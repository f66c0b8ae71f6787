import random
import zlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("meridia.llm")

from meridia.llm import html_text, quality  # noqa: E402


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a<p>b &lt; c\xa0 d<br>e", "a\n\nb < c d e"),
        ('<script>var t="</p>";</script><article><h1>T</h1><p>x <b>y</b>z</p></article><footer>f</footer>', "T\n\nx yz"),
        ("<nav><ul><li>m</ul></nav><div class='ad'>buy</div><main><ul><li>one<li>two</ul></main>", "one\n\ntwo"),
        ('<body><form><div class="content"><h1>T &amp; x</h1><p>a<b>b</b> c &lt;d<p>e</div></form><div id="comments"><article>no</article></div>', "T & x\n\nab c <d\n\ne"),
        ("<article><p>a</p><aside>s</aside><div class='share-box'>s</div><p hidden>h</p><p>b</p></article>", "a\n\nb"),
        ("<div class=ad>unclosed<article><p>kept</p></article>", "kept"),
        ("<!-- <p>no</p> --><title>no</title><p>yes", "yes"),
        ("<article><p>1</p><section class='comments'><p>c</p></section></article>", "1"),
        ("<div class='page has-sidebar'><article class='post comments-open'><p>kept</p></article><div class='sidebar'>s</div></div>", "kept"),
        ("<div id=main-content><header><h1>T</h1></header><p>x</p></div><div class=newsletter-signup><p>s</p></div>", "T\n\nx"),
        ("<div id='siteHeader'>h</div><div class=cookieBanner>c</div><div class='postContent'><h1>T</h1><ins class=adsbygoogle>x</ins><p>y</p></div><p class=copyright>z</p>", "T\n\ny"),
        ("<div class='ADS'>a</div><p>b</p>", "b"),
        ("<p>a</br>b</p></p>c", "a b\n\nc"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
    ],
)
def test_main_text_of_one_page(html, want):
    assert html_text.parse(html).text() == want


@pytest.mark.parametrize(
    "html,want",
    [
        ("<div>" * 50_000 + "x" + "</div>" * 50_000, "x"),
        ("<a " * 500_000, ""),
        ("<a " * 300_000 + '"', ""),
        ("<!" * 500_000, ""),
        ("<script " * 200_000, ""),
        ("<div>" * 100_000 + "x" + "</p></span></li>" * 100_000, "x"),
        ("<div>" * 50_000 + "<li>x</li>" * 10, "\n\n".join("x" * 10)),
        ("<span class=ad>" + "<span>" * 50_000 + "<div>x</div>" * 50_000, ""),
        ("<div class='" + "a-" * 500_000 + "'>x</div>", "x"),
        ("<p>" + "<b>x</b>" * 100_000, "x" * 100_000),
    ],
    ids=str,
)
def test_odd_long_pages_are_read_in_linear_time(html, want):
    start = time.process_time()
    page = html_text.parse(html)
    assert page.text() == want
    page.text(page.hashes())
    assert time.process_time() - start < 4


def test_template_removal(spark):
    pages = []
    for i in range(12):
        pages.append((i, "https://A.example/%d" % i, "<div>Site of fun</div><p>Body %d</p><div>Terms <b>apply</b></div>" % i, "x"))
    pages += [(20, "https://b.example/", "<div>Site of fun</div><p>other</p>", "x"), (21, None, None, "x"), (21, "::", "<p>z</p>", "x")]
    # Copies of one page count once, so their own text isn't template.
    pages += [(100 + i, "https://c.example/%d" % i, "<div><p>same article</p></div>", "x") for i in range(9)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = sorted(tuple(r) for r in html_text.main_text(frame).select("page_id", "text", "n_chars").collect())
    want = [(i, "Body %d" % i, len("Body %d" % i)) for i in range(12)] + [(20, "Site of fun\n\nother", 18), (21, "", 0), (21, "z", 1)]
    want += [(100 + i, "same article", 12) for i in range(9)]
    assert got == sorted(want)
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_template_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(html_text, "BROADCAST_HASHES", 0)
    test_template_removal(spark)


@pytest.mark.parametrize(
    "html,want",
    [
        ("<article><p>a</p><section id='discussion'><h2>Discussion</h2><p>b</p></section></article>", "a\n\nDiscussion\n\nb"),
        ("<article><h2 id='related-work'>R</h2><p>a</p><h2 id='social-impact'>S</h2><p id=newsletter>b</p></article>", "R\n\na\n\nS\n\nb"),
        ("<article><p class='alert alert-info'>a</p><div class='notice'><p>b</p></div><h2 class=share>c</h2></article>", "a\n\nb\n\nc"),
        ("<article><p>a</p><div class=related><p><a href=x>one</a><p><a href=y>two</a></div><p>b</p></article>", "a\n\nb"),
        ("<article><p>a</p><div class=related>see <a href=x>one</a> for the rest of it</div></article>", "a\n\nsee one for the rest of it"),
        ("<article><p>a</p><section id=comments><p>c</p></section><div class=sidebar>d</div></article>", "a"),
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='application/x-tex'>x=1</annotation></math> be", "let x=1 be"),
        ("<div>x</div><main><h1>T</h1><p>lead</p><article>teaser</article></main>", "T\n\nlead\n\nteaser"),
    ],
)
def test_article_text_stays(html, want):
    assert html_text.parse(html).text() == want


def test_doubtful_container_on_many_pages(spark):
    part = "<section id=discussion><p>Join us</p></section>"
    pages = [(i, "https://a.example/", "<article><p>own %d</p>%s</article>" % (i, part)) for i in range(4)]
    pages += [(9, "https://b.example/", pages[0][2])]
    got = dict(html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).select("page_id", "text").collect())
    assert got == {**{i: "own %d" % i for i in range(4)}, 9: "own 0\n\nJoin us"}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_template_on_a_small_share_of_a_host(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_text, "BROADCAST_HASHES", broadcast)
    pages = []
    for i in range(60):
        outside = "<div>Terms <b>apply</b></div>" if i < 5 else "<div>three</div>" if i < 8 else ""
        inside = "<div><p>Read on</p></div>" if 20 <= i < 25 else "<p>quoted</p>" if i < 50 else ""
        advert = "<div class=ad>%d</div>" % i
        pages.append((i, "https://a.example/%d" % i, "<div>%s%s</div><article><p>own %d</p>%s</article>" % (outside, advert, i, inside)))
        pages.append((100 + i, "https://b.example/%d" % i, "%s<p>own %d</p>" % (outside, i)))
    pages.append(pages[0])
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in html_text.main_text(frame).select("page_id", "text").collect())
    want = []
    for i in range(60):
        want.append((i, "own %d" % i + ("\n\nquoted" if i < 50 and not 20 <= i < 25 else "")))
        want.append((100 + i, ("three\n\n" if 5 <= i < 8 else "") + "own %d" % i))
    assert got == sorted(want + [want[0]])
    page = html_text.parse("<nav><ul><li>m</ul></nav><p>x</p>")
    assert len(page.elements) == 4 and sum(frame is not None for _, frame, _, _ in page.elements) == 1


def _site(rng, host, n):
    """Pages of a host: parts that recur word for word, a menu and a footer whose words differ, and own text."""
    common = [f"Part {host} {k}" for k in range(5)]
    for _ in range(n):
        menu = "".join(f"<li><a href=x>{rng.random()}</a></li>" for _ in range(rng.randrange(3, 6)))
        parts = [f"<div class=box><p>{c}</p></div>" for c in common if rng.random() < 0.4]
        own = [f"<p>own {rng.random()}</p>" for _ in range(rng.randrange(1, 4))]
        body = [f"<div class=m><ul>{menu}</ul></div>", *parts, *own, f"<div class=ad>{rng.random()}</div>"]
        rng.shuffle(body)
        yield f"https://{host}.example/{rng.random()}", "".join(body)


@pytest.mark.parametrize("broadcast", [500_000, 3, 0])
def test_template_removal_against_counting_by_hand(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_text, "BROADCAST_HASHES", broadcast)
    rng = random.Random(8)
    rows = [row for host, n in (("a", 40), ("b", 9), ("c", 3), ("d", 1)) for row in _site(rng, host, n)]
    rows += rows[:5] * 3
    cut = re.compile(r"<div class=(box|m|ad)>(.*?)</div>")
    pages: dict[str, set[str]] = defaultdict(set)
    menus: Counter = Counter()
    for url, html in set(rows):
        host = html_text.host_of(url)
        menus[host] += 1
        for kind, inner in cut.findall(html):
            if kind == "box":
                pages[f"{host} {inner}"].add(html)

    def by_hand(url, html):
        host = html_text.host_of(url)

        def stays(m):
            if m[1] == "m":
                return m[0] if menus[host] < html_text.MIN_PAGES else ""
            return m[0] if m[1] == "box" and len(pages[f"{host} {m[2]}"]) < html_text.MIN_PAGES else ""

        return "\n\n".join(re.findall(r">([^<]+)<", cut.sub(stays, html)))

    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(frame).collect()}
    assert got == {i: by_hand(*r) for i, r in enumerate(rows)}


def test_registered_pages_lose_their_furniture_to_the_template(spark):
    """On the given pages the counted subtrees, not the names, remove what is no article."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url", "html").collect()
    made, seen = [], defaultdict(set)
    for url, html in rows:
        host = html_text._hash(html_text.host_of(url))
        page = html_text.parse(html)
        made.append((page, html_text._page_keys(page, host)))
        for key in made[-1][1].values():
            seen[key].add(html)
    template = {k for k, pages in seen.items() if len(pages) >= html_text.MIN_PAGES}
    removed = [page.removed({h for h, k in keys.items() if k in template}) for page, keys in made]
    by_template, by_name = (sum(r[i] for r in removed) for i in (0, 1))
    assert by_template > 20 * by_name


def test_quality_held_out_accuracy(spark):
    rng = random.Random(4)
    words = "the of and thing thre erond hathe with thand ster oner".split()
    rows, labels = [], []
    for i in range(600):
        text = " ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randrange(10, 200)))
        good = i % 3 != 0
        if not good:
            text = rng.choice([text.upper(), text.replace(" ", "### "), " ".join(text.split()[:3] * 30)])
        rows.append((i, text, 0.5))
        labels.append((i, int(good), 0))
    rows += [(None, "words", 0.1), (900, None, 0.1), (901, "", 0.1), (902, "z" * 100_000, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y double")
    marks = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_report(docs, marks).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert len(held) > 50 and sum(got[i].predicted == (i % 3 != 0) for i in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values()) and len(got) == 604
    assert quality.quality_report(docs, marks.limit(0)).filter("score = 0.5").count() == 604
    assert quality.quality_report(docs.limit(0), marks).count() == 0


def _plain_split(grad, hess):
    """The best cut of bins by trying each one: (gain, cut)."""
    score = lambda g, h: sum(g) ** 2 / (sum(h) + quality._RIDGE)
    gains = [score(grad[:c], hess[:c]) + score(grad[c:], hess[c:]) - score(grad, hess) for c in range(1, len(grad))]
    best = max(range(len(gains)), key=lambda c: gains[c], default=None)
    return (0.0, 0) if best is None else (gains[best], best + 1)


def _plain_tree(grad, hess, depth):
    gain, cut = _plain_split(grad, hess) if depth else (0.0, 0)
    if gain <= 1e-6:
        return [sum(grad) / (sum(hess) + quality._RIDGE)] * len(grad)
    return _plain_tree(grad[:cut], hess[:cut], depth - 1) + _plain_tree(grad[cut:], hess[cut:], depth - 1)


def test_trees_against_a_naive_gain_search():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 12)
        grad, hess = [rng.uniform(-3, 3) for _ in range(n)], [rng.uniform(0.01, 2) for _ in range(n)]
        got = quality._tree(np.array(grad), np.array(hess), 2)
        assert np.allclose(got, _plain_tree(grad, hess, 2))


def test_scores_and_training_against_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 3)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 2)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(90, 3)), 1)
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)
    model = quality.train(x, y)

    def bin_of(f, v):
        return sum(v >= e for e in model.edges[f])

    def logit(row):
        b = [bin_of(f, v) for f, v in enumerate(row)]
        return model.base + sum(t[b[f]] for f, t in enumerate(model.tables)) + sum(t[b[f], b[g]] for f, g, t in model.pairs)

    assert np.allclose(model.score(x), [1 / (1 + np.exp(-logit(r))) for r in x])
    # The tables of single features by the same rounds, one row at a time.
    total, tables = [model.base] * len(y), [[0.0] * (len(e) + 1) for e in model.edges]
    for _ in range(3):
        for f, table in enumerate(tables):
            at = [bin_of(f, v) for v in x[:, f]]
            p = [1 / (1 + np.exp(-t)) for t in total]
            grad, hess = [0.0] * len(table), [0.0] * len(table)
            for i, b in enumerate(at):
                grad[b] += y[i] - p[i]
                hess[b] += max(p[i] * (1 - p[i]), 1e-6)
            step = [quality.RATE * v for v in _plain_tree(grad, hess, 2)]
            tables[f] = [a + b for a, b in zip(table, step)]
            total = [t + step[b] for t, b in zip(total, at)]
    assert all(np.allclose(a, b) for a, b in zip(model.tables, tables))
    assert len(model.pairs) == 3 and all(np.isfinite(t).all() for _, _, t in model.pairs)


def test_quality_of_repeated_rows_and_clashing_columns(spark):
    rows = [(i % 7, "good words of a text %d" % i if i % 2 else "!!! ### |||" * i) for i in range(40)] + [(3, None), (3, None)]
    docs = spark.createDataFrame([(*r, 0.5, "z", 1) for r in rows], "doc_id long, text string, score double, x string, labelled int")
    marks = spark.createDataFrame([(i, i % 2, 9) for i in range(7)] * 2, "doc_id long, quality int, y int")
    got = quality.quality_report(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) >= 1
    again = quality.quality_report(docs.repartition(5), marks).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_templates_decide_the_text_where_no_tag_or_name_does(spark):
    """The registered pages with all telling tags and names replaced: what recurs on a host, and nothing of the article, goes."""
    from pyspark.sql import functions as F

    pages = html_text.table(spark, "/root/testdata/sf0.1", "pages")
    told = {r.page_id: r.text for r in html_text.main_text(pages).collect()}

    def texts(tags, names):
        html = F.regexp_replace("html", rf"<(/?)({tags})\b", "<$1div")
        html = F.regexp_replace(html, r'\s(class|role|id)="[^"]*"', "") if names else html
        return {r.page_id: r.text for r in html_text.main_text(pages.withColumn("html", html)).collect()}

    plain = texts("article|main", False)
    assert plain == told
    bare = texts("article|main|nav|aside|footer|header", True)
    same = sum(bare[i] == t for i, t in told.items())
    assert same >= 0.95 * len(told) and all(bare.values())
    lost = sum(not set(t.split("\n\n")) <= set(bare[i].split("\n\n")) for i, t in told.items())
    assert lost == 0


def test_quoted_paragraphs_stay_without_an_article_element(spark):
    quote = "A paragraph that many pages of this host quote, long enough to be text and no menu."
    furniture = "<div><a href='/a'>one</a><a href='/b'>two</a><a href='/c'>three</a></div>"
    rows = [(i, "http://h.example/", f"<body>{furniture}<div><h1>Title {i}</h1><p>{quote}</p><p>{'own words ' * 9}{i}</p></div><div>contact {i}</div></body>") for i in range(12)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 12
    for r in got:
        assert r.text == f"Title {r.page_id}\n\n{quote}\n\n{'own words ' * 9}{r.page_id}"


def test_repeated_ids_do_not_widen_the_training_sample(spark):
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(200)] + [(3, "three"), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(1, 0), (3, 0), (8, 1), (None, 1)], "doc_id long, quality long")
    learned = [i for i in (1, 3, 8) if zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = quality.training_rows(docs, labels)
    assert len(y) == len(x) == len(learned) + (1 in learned) and learned
    assert len(quality.training_rows(docs, labels, rows=1)[1]) <= 1
