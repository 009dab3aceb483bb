import pytest
from hypothesis import given
from hypothesis import strategies as st
from pointloom.llm import html_text as H

LONG = "This sentence of the story is long enough to count as running text on any page of the web. "


def test_article_pages():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>'</script></head><body><header><h1>Site</h1></header>"
        "<nav><ul><li><a href='/x'>Menu</a></li></ul></nav><!-- <p>no</p> --><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p><b>One<br>two\n  three.<br>"
        "<p>Be.</p><div class='share-bar'>Share!</div><form>Mail <input></form><p>caf&eacute; &lt;tag&gt; &#169;</p></article>"
        "<section class='comments'><p>" + LONG * 3 + "</p></section><footer>&copy; x</footer></body></html>"
    )
    assert H.extract(page) == "A & B\nOne two three.\nBe.\ncafé <tag> ©"


def test_pages_without_article():
    page = (
        "<body><div id='header'>Site name</div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div class=content><h2>Title</h2><p>"
        + LONG
        + "</p><p>Short.</p><p>"
        + LONG
        + "</p></div><hr><hr><hr><div class='sidebar'><p>"
        + LONG
        + "</p></div><div>&copy; 2020</div></body>"
    )
    assert H.extract(page) == "\n".join(["Title", LONG.strip(), "Short.", LONG.strip()])


def test_regions():
    assert H.regions([0, 5, 0, 90, 10, 0, 0, 0, 4, 0], 86) == [(1, 5)]
    assert H.regions([], 86) == [] and H.regions([1, 1], 86) == []


def test_edges(spark):
    assert H.extract("") == H.extract(None) == H.extract("<nav>only menu</nav>") == ""
    assert H.extract("<article><p>cut <b>off</b> here <a hre") == "cut off here"
    assert H.extract("<article><p>a < b and c > d</article>") == "a < b and c > d"
    assert H.extract("<article>" + "<div>" * 3_000 + "deep" + "</article>") == "deep"
    assert H.extract("<div class='page sidebar-left'><article><p>kept</p></article></div>") == "kept"
    rows = [(1, "u", None, 3), (None, None, "<main><p>x</p></main>", 3), (2, "u", "<article>" + "<p>w w</p>" * 20_000 + "</article>", 3), (2, "u", "", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.text[:5], r.n_chars) for r in H.extract_pages(df).collect())
    assert got == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "w w\nw", 20_000 * 4 - 1)]
    assert H.extract_pages(df.limit(0)).count() == 0


PARA = "A paragraph that goes on and on for quite some time, so that windows surge well beyond eighty-six characters."


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div>{}</div>", "{}"])
@pytest.mark.parametrize(
    "part, text",
    [
        ('<div class="share-price">The share price rose.</div>', "The share price rose."),
        ('<p class="notification-letter">Dear reader.</p>', "Dear reader."),
        ('<section id="search-for-truth"><p>It is hard.</p></section>', "It is hard."),
        ("<p>x <math><mi>E</mi></math> y</p>", "x E y"),
        ("<p>a <svg><text>S</text></svg> b</p>", "a S b"),
        ("<object>of old</object>", "of old"),
        ('<div class="share-bar">Tell friends</div>', None),
        ('<div class="ad-leaderboard">Buy</div>', None),
        ('<div id="related_posts">More</div>', None),
        ('<ul class="user-comments"><li>First!</li></ul>', None),
        ('<div class="social sharing">Post it</div>', None),
        ('<form><p>Your name</p></form>', None),
    ],
)
def test_names_of_furniture_and_of_text(wrap, part, text):
    page = "<nav>Home</nav>" + wrap.format(f"<h1>Title</h1><p>{PARA}</p>{part}<p>{PARA}</p><p>End.</p>") + "<footer>f</footer>"
    want = ["Title", PARA, *([text] if text else []), PARA, "End."]
    assert H.extract(page).split("\n") == want


def test_lines_that_lead_up_and_the_last_ones_stay():
    short = "".join(f"<p>Short {k}.</p>" for k in range(6))
    page = f"<html><body><nav>Home</nav><h1>Title</h1>{short}<p>{PARA}</p>{short}<p>Bye.</p><footer>f</footer></body></html>"
    want = ["Title", *[f"Short {k}." for k in range(6)], PARA, *[f"Short {k}." for k in range(6)], "Bye."]
    assert H.extract(page).split("\n") == want


def brute_regions(lengths, surge, window):
    """The definition by plain sums: from a line whose window surges to the first line whose window is empty."""
    out, i = [], 0
    while i < len(lengths):
        if lengths[i] and sum(lengths[i : i + window]) >= surge:
            j = i
            while j < len(lengths) and sum(lengths[j : j + window]) > 0:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


@given(st.lists(st.sampled_from([0, 0, 0, 1, 20, 60, 90]), max_size=40), st.integers(1, 120), st.integers(1, 5))
def test_regions_equal_their_definition(lengths, surge, window):
    assert H.regions(lengths, surge, window) == brute_regions(lengths, surge, window)
