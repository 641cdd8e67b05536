import random

from .util import EDGE

PAGE = """<!doctype html><html><head><title>T &amp; x</title><style>p{}</style></head><body class="has-sidebar page">
<header id="masthead"><h2>Site name</h2><p>Slogan of the site that is quite long indeed</p></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for all of you, do you agree?</div>
<main><article class="post"><h1>Head&shy;line &#233;&#x41; &lt;b&gt;</h1>
<p>First  <b>bold</b>
 text with <a href="x>y">a link</a> inside.<p>Second paragraph, <i>unclosed
<div class="ad">Buy now the best things, only today and only here!</div>
<ul><li>One</li><li>Two</li></ul><table><tr><td>c1</td><td>c2</td></tr></table>
<script>var x = "<p>no</p>";</script><!-- <p>gone</p> -->
<form><label>Name</label><input><button>Send</button></form>
<p hidden>secret</p><p>1 < 2 &amp;amp; 3 > 2</p></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I think that this article is very good and long.</p></div></section></main>
<aside class="sidebar"><p>Popular stories of this week that everyone reads now</p></aside>
<footer><p>&copy; site, all rights reserved, and more words here</p></footer></body></html>"""
WANT = "Head\xadline éA <b>\nFirst bold text with a link inside.\nSecond paragraph, unclosed\nOne\nTwo\nc1\nc2\n1 < 2 &amp; 3 > 2"


def test_blocks_and_text():
    from rulemill.llm.html_extract import main_text

    assert main_text(PAGE) == WANT
    plain = "<body><div id=menu><a href=1>Home</a> <a href=2>News</a></div><div>" + "<p>" + "word " * 40 + "</p>" * 1 + "<p>" + "more " * 30 + "</p></div><div class=footer>bye</div></body>"
    assert main_text(plain) == " ".join(["word"] * 40) + "\n" + " ".join(["more"] * 30)
    assert main_text(None) == main_text("") == main_text("<") == ""


def test_splits_equal_brute_force():
    """The tree's splits against all cuts of all features."""
    from rulemill.llm.html_extract import FEATURES, LEAST, best_split, labelled

    def impurity(rows):
        p = sum(r[-1] for r in rows) / len(rows)
        return len(rows) * p * (1 - p)

    def brute(rows):
        found = []
        for f in range(len(FEATURES)):
            values = sorted({r[f] for r in rows})
            for a, b in zip(values, values[1:]):
                low, high = [r for r in rows if r[f] <= (a + b) / 2], [r for r in rows if r[f] > (a + b) / 2]
                if min(len(low), len(high)) >= LEAST:
                    found.append((impurity(low) + impurity(high), f, (a + b) / 2))
        return found

    rnd = random.Random(1)
    rows = [r for page in labelled() for r in page]
    for n in (5, 20, 60, len(rows)):
        part = rnd.sample(rows, n)
        got, want = best_split(part), brute(part)
        least = min(x for x, _, _ in want)
        assert abs(got[0] - least) < 1e-6 and got[1:] == min((f, c) for x, f, c in want if x < least + 1e-6)


def test_held_out_pages():
    """Trees of seven eighths of the labelled pages on the rest; the full tree on all; every kind of feature is used."""
    from rulemill.llm.html_extract import FEATURES, grow, is_main, labelled, tree

    pages = labelled()
    good = total = 0
    for k in range(8):
        node = grow([r for i, p in enumerate(pages) if i % 8 != k for r in p])
        for r in (r for i, p in enumerate(pages) if i % 8 == k for r in p):
            good, total = good + (is_main(r[:-1], node) == bool(r[-1])), total + 1
    assert good >= 0.85 * total, good / total
    rows = [r for p in pages for r in p]
    assert sum(is_main(r[:-1]) == bool(r[-1]) for r in rows) >= 0.98 * len(rows)

    def used(node):
        return {FEATURES[node[0]]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()

    assert {"words", "links"} <= used(tree()) and used(tree()) & {"prev_words", "prev_links", "next_words", "next_links"}


def test_names_are_hints_only():
    from rulemill.llm.html_extract import main_text

    long = "This part of the article is long enough to be read as text, and what stands around it is text as well, without any links."
    page = f"<article><h1>Title of it</h1><p>{long}</p>%s<p>{long}</p></article>"
    want = f"Title of it\n{long}\n{{}}\n{long}"
    for name in ("advert-free-post", "side-by-side", "teaser", "post-header", "noticeboard", "adsorption", "no-sidebar"):
        assert main_text(page % f"<div class='{name}'><p>{long}</p></div>") == want.format(long), name
    for name in ("ad", "ads", "cookie-notice", "sidebar", "newsletter-signup", "comments", "comment-list", "relatedPosts", "share"):
        assert main_text(page % f"<div class='{name}'><p>{long}</p></div>") == main_text(page % ""), name
        assert main_text(page % f"<div class='{name}'><p>Short one here.</p></div>") == main_text(page % ""), name
    assert main_text(page % "<div class='advert-inline-x'><p>Buy it now.</p></div>") == main_text(page % "")  # weak hint, short
    assert main_text(page % "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>") == want.format("So x=2 holds.")
    assert main_text(page % "<p>Press <button>Start</button> twice.</p>") == want.format("Press Start twice.")
    assert main_text(page % "<form><p>Your name</p><button>Send</button></form>") == main_text(page % "")
    menu = "<ul>" + "".join(f"<li><a href={i}>Part {i}</a></li>" for i in range(6)) + "</ul>"
    assert main_text(page % menu) == main_text(page % "")  # neighbours are links alone
    assert main_text(page % "<p><a href=x>See the whole list</a></p>") == want.format("See the whole list")  # neighbours are text
    outer = f"<main><article><p>{long}</p></article><div><p>{long}</p><p>{long}</p></div></main>"
    assert main_text(outer) == long
    assert main_text(f"<main><h1>A title</h1><p>{long}</p><p>Short.</p><p>{long}</p></main><div>{long}</div>") == f"A title\n{long}\nShort.\n{long}"


def test_odd_markup_ends():
    from rulemill.llm.html_extract import main_text

    rnd = random.Random(4)
    bits = ["<p>", "</p>", "<div class='a", "'>", '"', "<", ">", "<!--", "-->", "<script>", "</script>", "&amp", "text ", "</div>", "<a href=", "</article>", "<article>", "<li/>"]
    for _ in range(3000):
        main_text("".join(rnd.choices(bits, k=30)))
    main_text("<" * 20000), main_text("<p>" * 20000), main_text("<a b='" * 5000), main_text("</" * 20000)


def test_query(spark):
    from rulemill.llm.html_extract import extract_pages, main_text

    html = [PAGE, *EDGE]
    pages = spark.createDataFrame([(i, None if i == 2 else "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    for r in extract_pages(pages).collect():
        assert r.text == main_text(html[r.page_id]) and r.n_chars == len(r.text)
    assert extract_pages(pages.limit(0)).count() == 0


def test_other_columns(spark):
    from pyspark.sql import functions as F

    from rulemill.llm.html_extract import extract_pages

    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE)], "page_id long, url string, html string")
    pages = pages.withColumns({n: F.lit("x") for n in ("text", "n_chars", "words", "links")})
    assert [tuple(r) for r in extract_pages(pages).collect()] == [(1, "u", WANT, len(WANT))] * 2


def test_missing_end_tags():
    from rulemill.llm.html_extract import main_text

    assert main_text("<html><head><title>T</title><body><article><p>Main text here.</p>") == "Main text here."
    a, b = "First text of the article, quite long.", "Second text of the article, quite long."
    page = f"<article><p>{a}</p>%s<p>{b}</p></article>"
    for head in ("<head>", "<head><title>T", "<head><meta charset=u><title>T</title><link rel=x>", "<head><script>'<body><p>no</p>'</script><style>p</style>", "<head id=header class=banner>"):
        for body in ("", "<body>", "</head><body>", "</head>"):
            assert main_text(head + body + page % "") == f"{a}\n{b}", (head, body)
    for name in "select object textarea svg noscript template canvas audio video iframe datalist".split():
        assert main_text(page % f"<{name} x='>'>gone") == f"{a}\n{b}", name
        assert main_text(page % f"<{name}>gone" + f"<p>x</p><{name}>gone</{name}>") == main_text(page % "" + "<p>x</p>"), name
        assert main_text(page % f"<{name}><div>gone</div><p>gone</p></{name}>") == f"{a}\n{b}", name
        assert main_text(page % f"<{name}>gone<script>'</{name}>'</script></{name}>") == f"{a}\n{b}", name
    assert main_text(page % "<object><p>gone</p><object>gone</object><p>gone</p></object>") == f"{a}\n{b}"
    assert main_text(page % "<script>'<p>gone</p>'") == a
    assert main_text(page % "<select><option>gone</option><option>gone") == f"{a}\n{b}"
    main_text("<button>" * 20000), main_text("<object><p>" * 20000), main_text("<svg>" * 9000 + "</svg>" * 9000)


def test_boilerplate_inside_articles():
    """Menus, forms, asides and footers go whatever stands in them and beside them."""
    import itertools

    from rulemill.llm.html_extract import main_text

    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    inner = ["<a href=x>{}</a>", "<p>{}</p>", "<p><a>{}</a></p>", "<label>{}</label><input><button>Go now</button>", "<ul><li><a>{}</a></li><li><a>Next</a></li></ul>"]
    for element, before, after, n, what in itertools.product("nav form aside footer menu header".split(), (1, 20, 200), (1, 20, 200), (1, 5, 40), inner):
        page = f"<body><article><h1>Title</h1><p>{words(before, 'a')}</p><{element}>{what.format(words(n, 'bad'))}</{element}><p>{words(after, 'z')}</p></article></body>"
        assert main_text(page) == f"Title\n{words(before, 'a')}\n{words(after, 'z')}", page
