import pytest

from sparkwright.llm import html_extract
from sparkwright.llm.html_pages import labelled_pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy now.</div><article><h1>Head&amp;line</h1><p><b>One &lt;two&gt;<br>three   four<p>Fünf &am;<i>x</i>y</p><div class="comments"><p>I disagree with all of this.</p></div></article><footer>&copy; me</footer></body>"""


def test_page():
    assert html_extract.extract(PAGE, html_extract.trained()) == "Head&line One <two> three four Fünf &am;xy"


@pytest.mark.parametrize("layout", [{}, {"levels": (4, 6)}, {"levels": (2, 6), "apart": True}])
def test_held_out_pages(layout):
    """Other pages of the layouts that it learnt from, deeper wrappers than any of those, and layouts that it never saw."""
    crf, wrong, total = html_extract.trained(), 0, 0
    for markup, labels in labelled_pages(150, seed=77, **layout):
        found = html_extract.leaf_blocks(markup)
        for (_, text, _), label in zip(found, crf.decode(found), strict=True):
            wrong, total = wrong + (labels[text] != label), total + 1
    assert total > 2000 and wrong < 0.005 * total


def test_wrappers_lose_nothing():
    """What stands around the paragraphs of an article says nothing of them."""
    crf = html_extract.trained()
    inner = "<h1>Title of it</h1>%s<p>The first paragraph, a long one.</p><p>Short.</p>%s"
    want = "Title of it The first paragraph, a long one. Short."
    for depth in (0, 1, 2, 5):
        for tag in ("div", "section", 'div class="row"', 'section id="x1"'):
            opened, closed = f"<{tag}>" * depth, f"</{tag.split()[0]}>" * depth
            for around in ("<article>%s</article>", "<main>%s</main>", "<body>%s</body>", "<body><div>%s</div></body>"):
                for page in (around % (inner % (opened, closed)), around % (opened + inner % ("", "") + closed)):
                    assert html_extract.extract(page, crf) == want, page
    for page in ("<article><p>One<br>line</p></article>", "<p>One line", "<div>One line</div>", "<article><div><div>One line</div></div></article>", "One line"):
        assert html_extract.extract(page, crf) == "One line", page


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None), (3, "u", "", None), (4, "u", "just text", None), (None, "u", "<p>" * 3000 + "deep", None)], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r for r in html_extract.extract_main(pages).collect()}
    assert rows[2]["text"] == rows[3]["text"] == "" and rows[2]["url"] is None and rows[4]["n_chars"] == len(rows[4]["text"])
    assert html_extract.extract_main(pages.limit(0)).collect() == []


def test_viterbi_is_the_best_path():
    import itertools

    crf = html_extract.trained()
    blocks = html_extract.leaf_blocks(PAGE)

    def score(labels):
        s = crf.start[labels[0]] + sum(crf.block_score(b)[y] for b, y in zip(blocks, labels, strict=True))
        return s + sum(crf.move[a, b] for a, b in itertools.pairwise(labels))

    best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
    assert abs(score(best) - score(crf.decode(blocks))) < 1e-9


def test_broken_pages_take_linear_time():
    import time

    crf, art = html_extract.trained(), "<article><p>This is a sentence of the article, long enough to count.</p>"
    begun = time.time()
    for page in ("<div>" * 100_000 + "deep", "<div>a " * 100_000, art + "<a " * 100_000, art + "<a x='" * 100_000 + ">", art + "<b" * 100_000, "<div>" * 50_000 + "</section>" * 50_000, "<p><div>" + "<b>" * 50_000 + "<address>" * 50_000, "<ul><li>x" * 50_000, art + "<script>" * 50_000, art + "<svg>" * 100_000, art + "<!-- " * 50_000, f"<a {'b' * 200_000}>"):
        html_extract.extract(page, crf)
    assert time.time() - begun < 60
    short, long = (html_extract.extract(art + "<a " * k, crf) for k in (3, 3000))
    assert short.startswith("This is a sentence") and len(long) - len(short) == 2997 * len("<a ")


def test_elements_that_hide_their_content_and_heads_that_never_end():
    def texts(page):
        return [b[1] for b in html_extract.leaf_blocks(page)]

    assert texts("<article><p>One two <video src=x>fallback</p><p>Next one.</p></article>") == ["One two", "Next one."]
    assert texts("<article>a<svg><path d=1 /><text>t</text></svg>b<object>c</article><p>d") == ["ab", "d"]
    assert texts("<head><title>T</title><meta x=1><p>Hello there.</p>") == texts("<head><title>T</title>Hello there.") == ["Hello there."]
    assert texts("<p>1 < 2 and 3 > 2</p>") == ["1 < 2 and 3 > 2"] and texts('<a href=foo">x</a> y') == ["x y"]


def test_pages_table(spark):
    """Against the pages' own structure: the article's text between block tags, without what it marks as comments or adverts."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main(pages).collect()}
    same, total = 0, 0
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article[^>]*>(.*?)</article>", r["html"] or "", re.S)
        if not article:
            continue
        parts = re.split(r"</?(?:p|h\d|ul|ol|li|blockquote|pre|table|tr|td|th)\b[^>]*>", re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", article[1], flags=re.S))
        plain = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", p))).split()) for p in parts]
        total += 1
        same += " ".join(p for p in plain if p) == got[r["page_id"]]
    assert total > 50 and same == total
