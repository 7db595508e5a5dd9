import html
import pickle
import re
import zlib

from pyspark.sql import functions as F

from lattica.llm import queries, wrapper

FRAME = '<html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body><header><a href="/">Site</a></header><nav><ul>%s</ul></nav>%s<div class="cookie-notice">We use cookies</div>%s<aside><p>Side</p></aside><form><label>Mail</label><input name=a></form><footer>&copy; x</footer></body></html>'


def page(k, body, wrap="<article>%s</article>"):
    return FRAME % ("".join(f"<li><a href=/{i}>m{i}{k}</a></li>" for i in range(2 + k % 3)), '<div class="ad">buy</div>' * (k % 2), wrap % body)


def test_articles(spark):
    body = "<h1>Head &amp; more</h1><p>One<b>bold</b> two\n three<br>four<p>open <i>x</i></p><ul><li>a</li><li>b</li></ul><div class='comments'><p>nice!</p></div><script>bad()</script><!-- no -->tail &#233;"
    rows = [(k, f"http://a.example/{k}", page(k, body + f"<p>own {k}</p>")) for k in range(20)] + [(90, "http://a.example/x", None), (91, None, ""), (92, "junk", "<p>only <b>text"), (92, "junk", "<p>only <b>text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    assert got[3] == "Head & more Onebold two three four open x a b tail é own 3"
    assert got[90] == "" and got[91] == "" and got[92] == "only text"
    assert wrapper.main_text(df).count() == len(rows) and wrapper.main_text(df.filter("false")).count() == 0


def test_hosts_without_articles():
    pages = [page(k, f"<div id=x><span>Share this</span><p>Story {k} {'words ' * 30}{k}</p><p>More {k} {'and ' * 20}</p></div>", "<div>%s</div>") for k in range(8)]
    known = wrapper.Wrapper(*wrapper.wrapper(pages))
    assert not known.articles
    assert wrapper.extract(pages[5], known) == re.sub(" +", " ", f"Story 5 {'words ' * 30}5 More 5 {'and ' * 20}").strip()


def test_expression_of_two_pages():
    got = wrapper.infer(["<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>c</li><li>b</li><li>d</li></ul><b>new</b><p>y</p>"])
    assert [s.key for s in got] == ["<ul>", "(<li> # </li>)+", "</ul>", "<b>", "#", "</b>", "<p>", "#", "</p>"]
    assert [s.optional for s in got] == [False] * 3 + [True] * 3 + [False] * 3
    assert got[1].items[1].constant is None


def test_query_against_the_plain_article(spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = queries.op9_html_extraction(spark, data).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.DOTALL)[1]
        article = re.sub(r"</?(?:p|br|h1|li|ul)[^>]*>", " ", article)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", article)).split())
        assert " ".join(r.text.split()) == want and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_long_pages_are_read_to_the_end():
    menu = "".join(f"<div class=m{i}><i>go {i}</i></div>" for i in range(700))
    pages = [f"<body>{menu}<section><p>Story {k} {'words ' * 400}</p></section></body>" for k in range(4)]
    known = wrapper.Wrapper(*wrapper.wrapper(pages))
    assert wrapper.extract(pages[1], known) == f"Story 1 {'words ' * 400}".strip()
    assert wrapper.extract(pages[1]) == f"Story 1 {'words ' * 400}".strip()


def test_common_subsequences_are_longest(monkeypatch):
    import random

    draw = random.Random(1)
    for bits in (1 << 27, 40):
        monkeypatch.setattr(wrapper, "ROWS_BITS", bits)
        for _ in range(200):
            a, b = ([draw.choice("abcd") for _ in range(draw.randrange(25))] for _ in range(2))
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            got = wrapper.common(a, b)
            assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_pages_are_found_in_their_expression_as_by_the_common_subsequence():
    import random

    draw = random.Random(2)
    for _ in range(600):
        a = [draw.choice("abcdef") for _ in range(draw.randrange(40))]
        b = sorted(draw.sample(range(len(a)), draw.randrange(len(a) + 1)))
        b = [a[i] for i in b] if draw.random() < 0.7 else [draw.choice("abcdefg") for _ in b]
        assert wrapper.embedded(a, b, wrapper.places_of(a)) == wrapper.common(a, b)


def test_every_page_of_a_host_counts(spark):
    """Blocks that differ from page to page, and a second template that few pages have."""
    rows = [(k, "http://b.example/", f"<div class=node-{k}><p>Story {k} {'words ' * 30}</p></div>") for k in range(60)]
    rows += [(k, "http://b.example/", f"<section><p>Rare {k} {'and ' * 30}</p></section>") for k in range(60, 64)]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == re.sub("<[^>]*>", "", h).strip() for k, _, h in rows)


def test_the_match_decides(spark):
    """A host names its content on some pages only: the slot is content on all of them."""
    def one(k):
        return f"<body><section><i>Top {k}</i></section><div id={'content' if k % 2 else f'n{k}'}><p>Story {k}</p></div><div><u>More {k}</u></div></body>"

    rows = [(k, "http://c.example/", one(k)) for k in range(12)]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k}" for k in range(12)}


def test_only_the_wrapper_tells(spark):
    """Paragraphs whose class sounds like a frame: one that varies is article text, one that never does is not."""
    def one(k):
        return f"<body><nav>go</nav><div class=article><p class=search>How we search {k}</p><p class=notice>Terms apply.</p><p>Story {k}</p></div><footer>f</footer></body>"

    want = {k: f"How we search {k} Story {k}" for k in range(6)}
    rows = [(k, "http://d.example/", one(k)) for k in range(6)]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    alone = {k: wrapper.extract(one(k)) for k in range(6)}
    assert got == want and all(alone[k] != want[k] and "How we search" in alone[k] for k in want)


def test_constants_in_the_article_stay():
    pages = [f"<article><p>The same line on every page.</p><p>Story {k}</p></article>" for k in range(9)]
    known = wrapper.Wrapper(*wrapper.wrapper(pages))
    assert [wrapper.extract(p, known) for p in pages] == [f"The same line on every page. Story {k}" for k in range(9)]


def test_many_small_blocks():
    """300 sections of unequal size under classes of their own; a menu of as many blocks."""
    section = lambda i: f"Section {i} says this and that and some more. " * (1 + 9 * (i % 50 == 0))
    page = "".join(f"<div class=m{i}><i>go {i}</i></div>" for i in range(30)) + "<main-part>" + "".join(f"<section class=c{i}>{section(i)}</section>" for i in range(300)) + "</main-part>"
    assert wrapper.extract(page) == " ".join(section(i).strip() for i in range(300))


def test_expression_against_a_plain_aligner():
    """Slots and optional parts from a longest common subsequence by the textbook's table, over small hosts."""
    import random

    draw = random.Random(3)
    for _ in range(60):
        body = lambda: "".join(f"<{e}>{draw.choice('xyz')}</{e}>" for e in draw.sample(["p", "b", "h2", "pre"], draw.randrange(1, 5)))
        a, b = body(), body()
        left, right = ([t for t in wrapper.tokens(p)] for p in (a, b))
        keys = [[("#" + t.path) if t.key == "#" else t.key for t in side] for side in (left, right)]
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, x in enumerate(keys[0]):
            for j, y in enumerate(keys[1]):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = wrapper.infer([a, b])
        assert sum(not s.optional for s in got) == best[-1][-1] or a == b
        assert len(got) == len(left) + len(right) - best[-1][-1] or a == b


def test_odd_pages_and_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>par {i} &amp; more</p>" for i in range(30_000)) + "</article>"
    rows = [(1, None, "<article>a</article>", "h", "w"), (2, "http://e.example/", long, "h", "w"), (2, "http://e.example/", long, "h", "w"), (None, "x", "<p>b</p>", None, None), (4, "http://e.example/", "", "h", "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string").withColumn("k", F.lit(1)).withColumn("u", F.lit(2))
    got = sorted(((r.page_id or 0, r.text) for r in wrapper.main_text(df).collect()))
    whole = " ".join(f"par {i} & more" for i in range(30_000))
    assert got == [(0, "b"), (1, "a"), (2, whole), (2, whole), (4, "")]


def many_templates(templates, blocks):
    """Pairs of pages under class names of their own; only one page of a pair names its content."""
    def one(k):
        j = k // 2
        rest = "".join(f"<div class=t{j}-{i}><i>go {i}</i></div>" for i in range(blocks))
        return f"<body><section class=t{j}><i>{'Top words ' * 9}{k}</i></section><div class=t{j} {'' if k % 2 else 'id=content'}><p>Story {k}</p></div>{rest}</body>"

    return [(k, "http://f.example/", one(k)) for k in range(2 * templates)]


def test_expressions_forget_nothing(spark):
    """A host of 50 templates, each on two pages: some 6,000 nodes, most of them on two pages."""
    rows = many_templates(50, 60)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    known = wrapper.Wrapper(*pickle.loads(zlib.decompress(wrapper.wrappers(df).collect()[0].wrapper)))
    assert len(known.keys) == len(wrapper.infer([h for _, _, h in rows])) > 6000
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    assert got == {k: f"Story {k}" for k, _, _ in rows}


def test_named_content_stays_however_templates_are_aligned(spark, monkeypatch):
    """Expressions that are handed on after few nodes: a template's slots may stand apart in the host's."""
    monkeypatch.setattr(wrapper, "HELD", 700)
    rows = many_templates(20, 30)
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert all(got[k] == f"Story {k}" for k, _, _ in rows if not k % 2)
