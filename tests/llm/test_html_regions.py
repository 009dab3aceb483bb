from pointloom.llm import html_text as H

LONG = "This sentence of the story is long enough to count as running text on any page of the web. "
AD = "<div class='ad'>Buy</div>"


def test_windows_decide_on_pages_with_articles():
    story = f"<div><p>{LONG * 3}</p></div>"
    cards = "<article><h3>Card one</h3></article><article><h3>Card two</h3></article>"
    assert H.extract(f"<body>{story}{AD}{cards}</body>") == (LONG * 3).strip()  # cards do not surge, the story outside does
    assert H.extract(f"<p>{LONG}</p><article><p>{LONG}</p></article>") == "\n".join([LONG.strip()] * 2)
    page = f"<article><h1>Title</h1>{AD}<p>{LONG}</p>{AD}<div><p>He agreed.</p></div></article>"
    assert H.extract(page) == "\n".join(["Title", LONG.strip(), "He agreed."])


def test_article_elements_are_judged():
    noise = f"<article class='related'><p>{LONG}</p></article><section class='comments'><article class='comment'><p>{LONG}</p></article></section>"
    assert H.extract(f"<article><p>{LONG * 2}</p></article>{noise}") == (LONG * 2).strip()
    assert H.extract(f"<article hidden><p>{LONG}</p></article><article><p>Seen.</p></article>") == "Seen."
    assert H.extract(f"<div>Top</div><article class='has-sidebar'><p>{LONG}</p></article>").endswith(LONG.strip())


def test_short_parts_are_kept():
    for tag in ("div", "section"):
        page = f"<body><{tag}><p>{LONG * 9}</p></{tag}><{tag}><p>He agreed.</p></{tag}><{tag}><h2>Next</h2><p>{LONG}</p></{tag}><{tag}><p>End.</p></{tag}></body>"
        assert H.extract(page) == "\n".join([(LONG * 9).strip(), "He agreed.", "Next", LONG.strip(), "End."])
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(6))
    for inline in (AD, f"<ul>{links}</ul>"):
        got = H.extract(f"<body><div><p>{LONG * 9}</p>{inline}<p>He agreed.</p></div></body>")
        assert got.startswith(LONG.strip()) and got.endswith("\nHe agreed.") and "Buy" not in got
