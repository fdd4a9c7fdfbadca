import html
import random
import re
import time

from driftkit.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><div id="menu">Home About</div>
<main><header><h1>Big &amp; <i>bold</i> t&eacute;st</h1></header><p>One<br>two&nbsp;three<script>var x = "</p>";</script></p>
<div class="share-bar">share me</div><aside>side</aside><p>Four  five
six <a href=x>seven</a>.<p><b>open <p>next</b> one</p><ul><li>a b c<li>d e f</ul><form>Name <input></form>
<section class="comments"><p>nice post</p></section></main><!-- <p>gone</p> --><footer>f</footer>"""


def test_main_text():
    expected = "Big & bold tést\nOne two three\nFour five six seven.\nopen\nnext one\na b c\nd e f"
    assert H.main_text(PAGE) == expected


def test_unmarked_page():
    page = "<div><p>Plain page without marks but with a long paragraph.</p><p>And more text.</p></div><ul><li><a href=1>a</a><li><a href=2>b</a></ul>"
    assert H.main_text(page) == "Plain page without marks but with a long paragraph.\nAnd more text."


def test_edge_cases():
    for page in (None, "", "   ", "<p>", "<", "<!-- open", "<script>x", "<article></article>"):
        assert H.main_text(page) in ("", "<")
    assert H.main_text("<article>&amp &am &#233; &bogus; a &lt;b&gt;</article>") == "& &am é &bogus; a <b>"
    long = "<article>" + "<p>word word</p>" * 30_000 + "</article>"
    assert H.main_text(long).count("\n") == 29_999


def test_best_run_by_brute_force():
    draw = random.Random(5)
    for _ in range(300):
        scores = [draw.choice([-3, -1, 0, 1, 2]) for _ in range(draw.randint(0, 12))]
        sums = [(sum(scores[a:b]), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        a, b = H.best_run(scores)
        assert sum(scores[a:b]) == max([s for s, _ in sums if s > 0], default=0)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r for r in H.extract(pages, H.learn_weights(pages)).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for row in rows:
        article = re.search("<article>(.*?)</article>", row["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        r = found[row["page_id"]]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert (r["n_chars"], r["url"]) == (len(r["text"]), row["url"])


def test_tables_with_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, name string"
    rows = [(1, "u", PAGE, "x", 1, "n"), (1, "u", PAGE, "x", 1, "n"), (2, None, None, "x", 1, "n"), (None, "v", "", "x", 1, "n")]
    pages = spark.createDataFrame(rows, schema)
    found = H.extract(pages, H.learn_weights(pages)).collect()
    assert len(found) == 4 and [r["text"] for r in found if r["html" if "html" in r else "page_id"] is None] == [""]
    assert {(r["page_id"], r["text"] != "") for r in found} == {(1, True), (2, False), (None, False)}
    none = spark.createDataFrame([], schema)
    assert H.learn_weights(none) == H.DEFAULT and H.extract(none, H.DEFAULT).collect() == []


def test_wrappers_with_foreign_words_in_their_names():
    body = "<h1>A title</h1><p>The first long paragraph of it.</p><section id='related-work'><p>Work before ours.</p></section><p>The end.</p>"
    expected = "A title\nThe first long paragraph of it.\nWork before ours.\nThe end."
    more = "<div class='related-posts'><article><p>Another post</p></article></div><div id='comments'><article><p>Nice one</p></article></div>"
    for name in ("content-sidebar-wrap", "site no-sidebar", "has-comments", "social-policy", "sidebar-wrap", "widget"):
        for inside in (f"<article>{body}</article>", f"<main>{body}</main>", body):
            page = f"<body><nav>Home</nav><div class='{name}'>{inside}</div><div class='share-bar'>share me</div></body>"
            assert H.main_text(page) == expected, (name, inside)
        assert H.main_text(f"<body><main><h1>Site</h1><div class='{name}'><article>{body}</article></div>{more}</main></body>").endswith(expected)
        marked = f"<body><article>{body}<div class='comment-list'><p>{'so many words ' * 50}</p></div></article>{more}</body>"
        assert H.main_text(marked) == expected
    deep = "<div class='sidebar-wrap'>" * 200 + f"<article>{body}</article>" + "</div>" * 200
    assert H.main_text(deep) == expected


def test_data_attributes_are_no_names():
    assert H.main_text("<article><p data-id='share'>Kept words.</p><p class='share'>Gone</p></article>") == "Kept words."


def test_embedded_elements_lose_nothing_after_them():
    for part in (
        '<svg class="i"/>', '<svg><path d="M0"/><title>icon</title></svg>', '<iframe src="x"/>', '<iframe src="x">', "<iframe src=x></iframe>",
        "<video-player src=x></video-player>", "<script-x></script-x>", "<select><option>gone", "<button>", "<object data=x>", "<canvas>",
        "<button>gone</button>", "<select><option>gone</select>", "<video><p>gone</p></video>", "<template><p>gone</p></template>",
        "<script>if (a < b) '</p>'</script >", "<textarea></article></textarea>", "<style>p > a {}</style>", "<noscript><img></noscript>",
    ):
        page = f"<article><div><p>One two.</p><div>{part}</div><p>Three four.</p></div></article><footer>f</footer>"
        assert H.main_text(page).replace("\ngone", "") == "One two.\nThree four.", part
    twice = "<article><p>One.</p><div><button>gone</div><p>Two.</p><button>gone<button>gone</button><p>Three.</p></article>"
    assert H.main_text(twice) == "One.\nTwo.\nThree."
    assert H.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == "So x=2 holds."


def test_broken_pages_take_linear_time():
    n = 100_000
    ends = "<p>The end.</p>"
    begin = time.monotonic()
    for page in (
        "<a " + '"' * (n + 1) + ends, "<a " + "'" * n + ends, "<a " + "\"'" * n + ends, "<a \"" * n + ends, "<a '\"" * n + ends,
        "<a =\"<" * n + ends, "<!" * n + ends, "<script " + '"' * n + ends, "<" * n + ends, "<div>" * n + "</x>" * n + ends,
    ):
        H.main_text(page)
    assert time.monotonic() - begin < 20
    assert H.main_text("<article><p>One <a title=\"x>two</a> <b class='y'>three</b></p></article>") == "One two three"


def test_forms_around_the_page():
    body = "<h1>A title</h1><p>The first long paragraph of it.</p><p>The end.</p>"
    expected = "A title\nThe first long paragraph of it.\nThe end."
    fields = "<label>Your name</label><input><select><option>gone</option></select><button>Send</button>"
    for inside in (f"<article>{body}</article>", f"<main>{body}</main>", body, f"<fieldset>{body}</fieldset>"):
        page = f"<body><form method=post>{fields}<div>{inside}</div></form><form>Subscribe <input></form></body>"
        assert H.main_text(page) == expected, inside
    assert H.main_text(f"<body><article>{body}</article><form><p>{'many words ' * 90}</p></form></body>") == expected
    nested = "<form><div class='sidebar-wrap'>" * 20 + f"<article>{body}</article>" + "</div></form>" * 20
    assert H.main_text(nested) == expected


def test_nothing_inside_the_run_is_dropped():
    page = "<p>A long paragraph of the page, longer than the links around it, stands before.</p><ul><li><a>One link item</a></li></ul><p>A long paragraph of the page, longer than the links around it, stands after.</p>"
    lines = ["A long paragraph of the page, longer than the links around it, stands before.", "One link item", "A long paragraph of the page, longer than the links around it, stands after."]
    assert H.main_text(page) == "\n".join(lines)
    assert H.main_text(f"<article>{page}</article>") == "\n".join(lines)
