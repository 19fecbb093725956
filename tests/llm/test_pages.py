import random

import pytest

from orfspark.llm import pages
from orfspark.llm.html import counted, deletable, main_text, parse, subtrees

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b", "a\n\nb"),
        ("<article><h1>T &am</h1><p><b>One.<br><p>Two   w\n x</p></article>", "T &am\n\nOne.\n\nTwo w x"),
        ("<nav><ul><li>menu</ul></nav><p>x</p><footer>f</footer>", "x"),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>x</article>", "Title\n\nx"),
        ('<div class="ad">buy</div><div id="cookieNotice">c</div><p>x</p><div class="comments"><p>reader</p></div>', "x"),
        ('<script>var t = "</p><p>no</p>";</script><style>p{}</style><p>x', "x"),
        ("<!-- <p>no</p> --><p>x<!-- > --> y</p>", "x y"),
        ("<p>a &lt;b&gt; &#8211; &eacute; &nbsp; &copy</p>", "a <b> – é ©"),
        ("<p>1 < 2 and <i>it</i>alic</p>", "1 < 2 and italic"),
        ("<ul><li>One<li>Two</ul><table><tr><td>a</td><td>b</td></tr><tr><td>c</table>", "One\n\nTwo\n\na b\n\nc"),
        ("<article><p>x</p><form><p>sign up</p><input></form><aside>s</aside><p>y</article><p>outside</p>", "x\n\ny"),
        ("<div hidden>h</div><p style='display: none'>n</p><p aria-hidden=true>a</p><p>x</p>", "x"),
        ("<article><p>small</p></article><article><p>the larger one of both</p></article>", "the larger one of both"),
        ("</div></p><p>x</b></i> y</p><p class='a", "x y"),
        ("<p title=\"a>b\">x</p><a href='>'>l</a>", "x\n\nl"),
        ("<textarea><p>no</textarea><p>x", "x"),
        ("<P>Upper</P><BR/>z", "Upper\n\nz"),
        ("<pre>a\n  b</pre>", "a b"),
    ],
)
def test_main_text(html, text):
    assert main_text(parse(html)) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ('<p>Hello <span class="share">Share</span> world</p><p>x</p>', "Hello world\n\nx"),
        ("<p>a <button>b<div>c</div></button> d<br>e", "a d e"),
        ("<p>a <i hidden>b</p>c <label>d</label>e", "a\n\nc e"),
        ('<p><span class="ad">b</span>c <math>d</math> e <b aria-hidden=true>f<p>g', "c e\n\ng"),
        ("<nav>n</nav><table><tr><td>text</td><td class=ad>b</td><th>c</table>", "text c"),
        ('<div class="ad">x</div><br>text', "text"),
        ("<nav>n</nav>&nbsp;<div class=ad>x</div>&nbsp;<br/>text<div class=ad>y</div>", "text"),
    ],
)
def test_text_beside_furniture_stays(html, text):
    assert main_text(parse(html)) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>site</p><div><article><p>Part one.</article><article><p>Part two.</article><p>between</p><article><p>Part 3.</article></div>", "Part one.\n\nPart two.\n\nbetween\n\nPart 3."),
        ("<main><h1>Title</h1><p>The whole story.</p></main><div><article>teaser a</article><article>teaser b</article></div>", "Title\n\nThe whole story."),
        ("<main><p>The whole story.</p><article>a teaser</article></main><article>elsewhere</article>", "The whole story.\n\na teaser"),
        ("<main><article><p>The whole long story.</p></article><p>tail</p></main><p>x</p>", "The whole long story."),
        ("<main>m</main><article><p>The whole long story.</p></article>", "The whole long story."),
        ("<article>Story and its comments. <article>first</article><article>second</article></article>", "Story and its comments.\n\nfirst\n\nsecond"),
        ("<article>ab</article><body><article>cd</article>", "ab\n\ncd"),
    ],
)
def test_article_and_main(html, text):
    assert main_text(parse(html)) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ('<article><div class="social-studies"><p>On schools.</p></div><section id="relatedWork"><p>Others did so too.</p></section></article>', "On schools.\n\nOthers did so too."),
        ('<p>x</p><div class="related-posts">r</div><div class="ad-slot-2">a</div><ul id="shareButtons"><li>s</ul><div class="wide social">s</div>', "x"),
        ('<p>x</p><p class="notice-period">The notice period is a month.</p><p class="noticeBox">n</p>', "x\n\nThe notice period is a month."),
    ],
)
def test_a_name_is_furniture_only_as_a_whole(html, text):
    assert main_text(parse(html)) == text


def test_long_and_deep_pages_end():
    assert main_text(parse("<div>" * 3000 + "x")) == "x"
    assert len(main_text(parse("<article>" + "<p>word &amp; more</p>" * 50_000))) == 50_000 * 11 + 2 * 49_999
    assert main_text(parse('<a href="' + "x" * 100_000)) == ""


def _site(n, body, host="a.example"):
    return [(i, f"https://{host}/{i}", f"<html><body>{body(i)}</body></html>") for i in range(n)]


def _texts(spark, rows):
    return {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, PAGES)).collect()}


BOX = "<div><p>Follow our channel</p></div>"


def test_recurring_subtrees_go_and_copies_stay(spark):
    text = lambda i: f"<p>Story {i} has words of its own number {i * i}</p>" * 3
    rows = _site(12, lambda i: f"<article>{text(i)}{BOX}<p>The same closing words.</p></article>")
    got = _texts(spark, rows)
    assert all("Follow" not in t and t.endswith("The same closing words.") and f"Story {i}" in t for i, t in got.items())
    # the same article on many pages is no template, neither as a whole nor in its parts
    copies = _site(40, lambda i: f"<article>{text(1)}{BOX}</article>", "b.example")
    assert all(t.count("Story") == 3 for t in _texts(spark, copies).values())


def test_pages_without_a_marked_article(spark):
    rows = _site(10, lambda i: f"<p>Welcome to this fine site</p><p>{' '.join(f'word{i}x{k}' for k in range(40))}</p>")
    assert all(t.startswith("word") for t in _texts(spark, rows).values())
    # too few pages for a template, and another host's count does not help
    assert all(t.startswith("Welcome") for t in _texts(spark, rows[:4]).values())


def test_templates_of_hosts_with_copies_and_of_large_hosts(spark, monkeypatch):
    story = lambda i: f"<p>Story {i} has words of its own number {i * i}</p>" * 6
    # 90 copies of one article and 12 others: the box stands beside 13 articles of 13
    rows = _site(102, lambda i: f"<article>{story(max(i, 89))}{BOX}</article>")
    got = _texts(spark, rows)
    assert len(got) == 102 and all("Follow" not in t and t.count("Story") == 6 for t in got.values())
    # a box on a tenth of the pages of a host, and a line that recurs there by chance
    monkeypatch.setattr(pages, "MANY_PAGES", 20)
    box = lambda i: (BOX + "<p>Thank you.</p>") * (i % 10 == 0)
    got = _texts(spark, _site(200, lambda i: f"<section>{story(i)}{box(i)}</section>"))
    assert all("Follow" not in t and t.count("Story") == 6 and ("Thank" in t) == (i % 10 == 0) for i, t in got.items())


def test_templates_of_short_pages(spark):
    story = lambda i: f"<p>Story {i} has words of its own number {i * i}</p>" * 6
    rows = _site(12, lambda i: f"<article>{BOX * (i != 11)}{story(i) if i < 10 else '<p>Short.</p>' if i == 10 else ''}</article>")
    rows.append((12, "https://a.example/12", f"<article>{BOX}</article>"))
    got = _texts(spark, rows)
    assert got[10] == "Short." and got[12] == "Follow our channel" and all("Follow" not in got[i] for i in range(10))
    # a copied story beside something small that differs is no template
    copies = _site(12, lambda i: f"<div><p>{'Copied words. ' * 20}</p></div><div>Visitor {i}</div>", "b.example")
    assert all(t.count("Copied") == 20 for t in _texts(spark, copies).values())


def test_templates_beside_sibling_articles(spark):
    part = lambda i, k: f"<article><p>Part {k} of {i} has words of its own</p><p>The same line.</p></article>"
    got = _texts(spark, _site(12, lambda i: f"<div>{part(i, 1)}{part(i, 2)}{part(i, 3)}{BOX}<p>Read on</p></div>"))
    assert all(t.count("Part") == t.count("The same line.") == 3 and "Follow" not in t and "Read on" not in t for t in got.values())


def test_templates_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = _site(12, lambda i: f"<article>{f'<p>Story {i} has words {i * i}</p>' * 3}{BOX}</article>")
    near = _texts(spark, rows)
    monkeypatch.setattr(pages, "BROADCAST_TEMPLATES", 0)
    assert _texts(spark, rows) == near and all("Follow" not in t for t in near.values())


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "https://u", ""), (None, "x", "<p>a"), (3, None, "<p>é😀</p>")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES + ", text string, host string, templates string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in pages.extract(df).collect())
    assert got == [(0, "x", "a", 1), (1, "", "", 0), (1, "", "", 0), (2, "https://u", "", 0), (3, "", "é😀", 2)]
    assert pages.extract(df.limit(0)).collect() == []


def _by_hand(rows, least=5, share=0.2, many=100):
    """The texts, with templates counted in plain loops over all pages of a host."""
    from urllib.parse import urlsplit

    read = [(i, urlsplit(u or "").netloc, parse(h or "")) for i, u, h in rows]
    texts = {}
    for i, host, page in read:
        beside, articles = {}, set()
        for _, other, p in read:
            if other == host:
                articles.add(p.elements[p.main].digest)
                for digest, prose, rest in counted(p):
                    beside.setdefault((digest, prose), set()).add(rest)
        found = {d for (d, prose), rests in beside.items() if len(rests) >= least and (len(rests) >= share * len(articles) or not prose and len(rests) >= many)}
        gone = {e for e, digest, _ in subtrees(page) if digest in found and deletable(page)[e]}
        ancestors = lambda e: {e} | ancestors(page.elements[e].parent) if e >= 0 else set()
        kept = [(t, ancestors(e)) for e, t in page.blocks if not page.elements[e].dropped and page.main in ancestors(e)]
        texts[i] = "\n\n".join([t for t, up in kept if not up & gone] or [t for t, _ in kept])
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_templates_equal_counting_by_hand(spark, seed):
    rng = random.Random(seed)
    boxes = [f"<div><p>Box {k} of the site</p></div>" for k in range(6)] + ["<p>Thank you.</p>", "<ul><li>One<li>Two</ul>"]
    story = lambda: "".join(f"<p>{' '.join(rng.choices('red green blue one two three'.split(), k=rng.randint(2, 9)))}</p>" for _ in range(rng.randint(1, 6)))
    rows = []
    for i in range(60):
        body = [story(), *rng.sample(boxes, rng.randint(0, 4))]
        rng.shuffle(body)
        rows.append((i, f"https://h{rng.randint(0, 2)}.example/{i}", rng.choice(["<article>{}</article>", "<main>{}</main>", "{}"]).format("".join(body))))
    rows += [(60 + k, "https://h0.example/c", rows[0][2]) for k in range(20)]
    expected = _by_hand(rows)
    assert _texts(spark, rows) == expected
    # the count decides: without it boxes stay
    assert expected != {i: main_text(parse(h)) for i, _, h in rows}
