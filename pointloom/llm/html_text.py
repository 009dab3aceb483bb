"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element gives a line; what stands in menus, headers, footers,
sidebars, notices, adverts, forms, comments and scripts is left out. Text lengths are summed over sliding windows
of the lines that hold text, on every page: where a window surges over the threshold the main text begins, where the next
window holds nothing it dives and ends. Lines of links have no length, and furniture with text is a
gap as wide as a window. The text between the first surge and the last dive is kept where no furniture
separates them, with the lines that lead up to it; so is what else stands in an article, main or other element that holds
kept text. Furniture is told by its tag, its role and the words of its class names and ids; words that may stand in
other names too count only beside plain words.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table

WINDOW = 3
#: Characters in a window from which text surges.
SURGE = 86
#: A line that is mostly links has no length of its own.
LINK_SHARE = 0.7

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th option img".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that hold parts of a text together.
BOXES = frozenset("article blockquote center div main section td".split())
OUT = frozenset("nav footer aside form dialog menu button fieldset label datalist".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
#: Words of class names and ids that name furniture wherever they stand.
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion promoted sidebar aside comment comments "
    "commentlist disqus trackback pingback cookie cookies gdpr newsletter subscribe "
    "recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation popup modal "
    "pagination pager masthead login signup signin toolbar footer copyright".split()
)
#: Words that name furniture only in a name of such and plain words: a share bar is some, a share price is not.
OUT_AMONG_PLAIN = frozenset(
    "share sharing social discussion replies reply respond response responses feedback consent subscription related overlay banner "
    "notice notification alert widget register search".split()
)
PLAIN = frozenset(
    "article articles area bar block blocks bottom box btn button buttons center col column container content count entry field fixed form "
    "global group header heading icon icons inline inner item items js large left link links list lists main media message module more news outer page "
    "panel post posts primary right row secondary section site slot small sticky stories story strip tag tags text thread title tools top unit "
    "wide wrap wrapper".split()
)
#: Words that end so are furniture too, as in topnav or pagefooter.
_OUT_END = re.compile(r"(?:nav|navbar|menu|sidebar|footer|comments?|cookies?|adverts?|banner|popup)$")
OUT_PAGE = frozenset("header head topbar top bottom foot".split())

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_RAW = re.compile(
    r"<(script|style|template|iframe|textarea|select|title|audio|video|canvas)\b[^>]*?(?<!/)>.*?(?:</\1\s*>|\Z)",
    re.S | re.I,
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z!?/][^<>]*\Z|<(/?)([a-zA-Z][^\s/>"']*)([^>]*)>""")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")


def _names_furniture(words: list[str], in_article: bool) -> bool:
    """Whether the words of one class name or id name page furniture."""
    if any(w in OUT_NAMES or _OUT_END.search(w) for w in words):
        return True
    if not in_article and any(w in OUT_PAGE for w in words) and all(w in OUT_PAGE or w in PLAIN for w in words):
        return True
    return any(w in OUT_AMONG_PLAIN for w in words) and all(w in OUT_AMONG_PLAIN or w in PLAIN for w in words)


def _noise(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is page furniture, by its tag, role or names."""
    if tag in OUT or tag in ("header", "noscript") and not in_article:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in OUT_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id"):
            if any(_names_furniture(_WORD.findall(x), in_article) for x in value.split()):
                return True
    return False


def lines(html: str, by_name: bool = True, judged: bool = True) -> tuple[list[tuple[str | None, int, int, int]], list[int]]:
    """(text, characters in links, article, box) of each line that holds text, and the parent of each box.

    Article and box are numbers of the elements around it, 0 if there is none. Furniture with text is a line whose text is
    None. ``judged`` tells whether article elements can be furniture. Character references are decoded after the markup is gone.
    """
    page = _RAW.sub(" ", _COMMENT.sub("", html))
    out: list[tuple[str | None, int, int, int]] = []
    parts: list[str] = []
    link_parts: list[str] = []
    depth = links = articles = 0
    skip, level, silent = "", 0, True  # the furniture element at hand, how deep its own tag nests, and whether it has no text yet
    parents, stack, opened = [0], [("", 0)], dict.fromkeys(BOXES, 0)

    def end() -> None:
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            linked = len(" ".join(unescape(" ".join(link_parts)).split())) if link_parts else 0
            out.append((text, linked, articles if depth else 0, stack[-1][1]))
        parts.clear()
        link_parts.clear()

    def enter(tag: str) -> None:
        parents.append(stack[-1][1])
        stack.append((tag, len(parents) - 1))
        opened[tag] += 1

    def leave(tag: str) -> None:
        while opened[tag]:
            last, _ = stack.pop()
            opened[last] -= 1
            if last == tag:
                break

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            if not skip:
                parts.append(text)
                if links:
                    link_parts.append(text)
            elif silent and text.strip():
                out.append((None, 0, 0, 0))
                silent = False
        at = m.end()
        closing, tag, attrs = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag in SPACED and not skip:
            parts.append(" ")
        if tag in ARTICLE and skip not in ARTICLE:
            end()
            noise = not closing and judged and _noise(tag, attrs if by_name else "", depth > 0)
            if noise and not skip:
                skip, level, silent = tag, 1, True
            elif not noise:
                if closing:
                    depth = max(0, depth - 1)
                else:
                    articles += not depth
                    depth += 1
                    if skip and skip not in OUT:  # a wrapper with a misleading name
                        for _ in range(level if skip in BOXES else 0):
                            enter(skip)
                        skip = ""
                if not skip:
                    leave(tag) if closing else enter(tag)
            continue
        if tag in BLOCKS:
            end()
        if closing:
            if tag == skip:
                level -= 1
                if not level:
                    skip = ""
            elif tag == "a":
                links = max(0, links - 1)
            elif tag in BOXES and not skip:
                leave(tag)
        elif skip:
            level += tag == skip and not attrs.endswith("/")
        elif tag not in VOID and not attrs.endswith("/"):
            if tag == "a":
                links = 1
            elif _noise(tag, attrs if by_name else "", depth > 0):
                end()
                skip, level, silent = tag, 1, True
            elif tag in BOXES:
                enter(tag)
    if not skip:
        parts.append(page[at:])
    end()
    return out, parents


def regions(lengths: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """[start, end) between each surge and the dive after it."""
    n = len(lengths)
    total, sums = 0, [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        total += lengths[i] - (lengths[i + window] if i + window < n else 0)
        sums[i] = total
    out, i = [], 0
    while i < n:
        if lengths[i] and sums[i] >= surge:
            j = i
            while j < n and sums[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def _main(rows: list[tuple[str | None, int, int, int]], parents: list[int]) -> list[str]:
    """The lines that are main text."""
    linked = [t is not None and k > LINK_SHARE * len(t) for t, k, _, _ in rows]
    lengths, line = [], []
    for i, (t, _, _, _) in enumerate(rows):
        wide = WINDOW if t is None else 1
        lengths += [0 if t is None or linked[i] else len(t)] * wide
        line += [i] * wide
    spans = regions(lengths, SURGE)
    if not spans:  # a page of short lines: all of its articles, or all it has
        if any(x for _, _, x, _ in rows):
            return [t for t, _, x, _ in rows if x and t]
        spans = regions(lengths, 1)
    keep = [False] * len(rows)
    last = None
    for a, b in spans:
        a, b = line[a], line[b - 1] + 1
        if last is not None and all(t is not None for t, *_ in rows[last:a]):
            a = last
        while a > (last or 0) and rows[a - 1][0] is not None and not linked[a - 1] and not rows[a - 1][3] and not rows[a][3]:
            a -= 1  # a heading and short lines that lead up to the surge, in no element of their own
        keep[a:b] = [True] * (b - a)
        last = b
    articles = {x for k, (_, _, x, _) in zip(keep, rows) if k} - {0}
    held = {box for k, (t, _, _, box) in zip(keep, rows) if k and t} - {0}
    inside = [False] * len(parents)
    for box in range(1, len(parents)):
        inside[box] = box in held or inside[parents[box]]
    out, begun = [], False
    for k, links, (t, _, x, box) in zip(keep, linked, rows):
        begun = begun or k and not box
        if t and (k or x in articles or not links and (inside[box] or not box and begun)):
            out.append(t)
    return out


def extract(html: str | None) -> str:
    """The main text of a page: its blocks in order, joined by line ends; empty if there is none."""
    if not html:
        return ""
    rows, parents = lines(html)
    if not any(x for _, _, x, _ in rows) and re.search("<(?:article|main)", html, re.I):
        again = lines(html, judged=False)  # all article elements were judged to be furniture, or hold nothing
        if any(x for _, _, x, _ in again[0]):
            rows, parents = again
    if not any(text for text, *_ in rows):
        rows, parents = lines(html, by_name=False, judged=False)  # names misled
    return "\n".join(_main(rows, parents))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``; null html gives an empty text.

    Every page is read whole by itself: repeated rows come out alike, null ids and urls are passed on, and
    other columns are not read. Unclosed elements and comments reach to the end of the page.
    """
    bounded_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    wanted = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return wanted.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
