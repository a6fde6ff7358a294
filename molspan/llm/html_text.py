"""Main text of web pages by the distribution of text over blocks of lines."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES, map_batches

# Element names of HTML, by what they are to a reader.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe object svg math canvas audio video select option datalist".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SELF_CLOSING = set("p li dt dd tr td th thead tbody tfoot option".split())
BOILERPLATE = set("nav footer aside form menu dialog button fieldset head".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MAIN = {"article", "main"}
HOLDERS = set("html body article main section div td center header footer aside nav form".split())
# Words in class and id attributes that name something other than the article.
NAMES = set(
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies cookiebar copyright disclaimer disqus "
    "dropdown foot footer form gdpr header login masthead menu menubar modal nav navbar navigation navi newsletter notice notices notification overlay pager pagination popup promo promoted promotion "
    "recommended related replies respond rail share sharing sidebar sidenav signup skip skiplink social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets".split()
)
# Words that name a place, beside one of NAMES in a compound such as site-footer.
PLACES = set("site main page global primary secondary top bottom list bar box area section wrapper container wrap block inner links link text left right".split())
OWN_HEAD = set("article entry post story content section".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile("[" + SPACES + "]+")
RIGHTS = re.compile(r"^(?:©|\(c\) \d|copyright\b|all rights reserved)", re.I)

#: Lines in a window, and characters that a window needs for a surge; also this share of the page's best window.
WINDOW, SURGE, OF_BEST = 3, 80, 1 / 8
#: Empty lines that the edge of an article, or of something that a tag or name tells of, leaves.
GAP = 3
#: Weight of text that a name, a form or a page's header tells of, and of what lies outside a page's articles.
NAMED_WEIGHT, OUTSIDE_WEIGHT = 0.02, 0.05

FIRM, SOFT = 1, 2


def is_boilerplate(tag: str, attributes: str, in_main: bool) -> int:
    """0; FIRM for elements that are never the article, which are cut; SOFT for a form, header or mere name, which weigh less.

    A name is a whole class or id, or a compound of NAMES and PLACES alone.
    """
    soft = tag == "form" or tag == "header" and not in_main
    if tag in BOILERPLATE and not soft:
        return FIRM
    if not attributes or tag in ("html", "body", *MAIN):
        return SOFT * soft
    for name, *value in NAMED.findall(attributes):
        name, value = name.lower(), next((v for v in value if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES - {"form"}:
            return FIRM
        if name == "role" and value == "form":
            soft = True
        if name in ("class", "id"):
            for token in value.split():
                words = {w for w in re.split(r"[^a-z0-9]+", token) if w}
                if words & NAMES and words <= NAMES | PLACES | OWN_HEAD and not (words & NAMES <= {"header", "byline"} and words & OWN_HEAD):
                    soft = True
    return SOFT * soft


class Line(NamedTuple):
    """A block's text, its characters outside links, how much each weighs, whether it is in an article, and its element.

    element: a number for the outermost article or main element around it, else for the
    innermost element that can hold one.
    """

    text: str
    plain: int
    weight: float
    in_main: bool
    element: int


EMPTY = Line("", 0, 0.0, False, -1)


def page_lines(page: str) -> list[Line]:
    """The lines of a page: what block elements divide, and GAP empty ones wherever the markup tells of an edge.

    Character references are decoded after the markup is gone, once. Each tag is looked at
    once, and what closes a raw element is looked for once, so the time grows with the page.
    """
    out: list[Line] = []
    text: list[str] = []
    linked = main = cut_out = soft = link = 0
    stack: list[tuple[str, bool, int]] = []
    open_: Counter[str] = Counter()
    path, opened, article = [0], 0, 0  # numbers of open elements, and of the outermost article
    shuts: dict[str, int] = {}

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not cut_out:
            text.append(piece)
            if link:
                linked += len(piece)

    def end_block() -> None:
        nonlocal linked
        if text:
            line = SPACE.sub(" ", html.unescape("".join(text))).strip(SPACES)
            if line:
                out.append(Line(line, max(0, len(line) - linked), NAMED_WEIGHT**soft, main > 0, article if main else path[-1]))
            text.clear()
            linked = 0

    def gap() -> None:
        end_block()
        out.extend([EMPTY] * GAP)

    def push(tag: str, is_main: bool, kind: int) -> None:
        nonlocal main, cut_out, soft, opened, article
        if is_main or kind:
            gap()
        stack.append((tag, is_main, kind))
        open_[tag] += 1
        if tag in HOLDERS:
            opened += 1
            path.append(opened)
        if is_main and not main:
            opened += 1
            article = opened
        main += is_main
        cut_out += kind == FIRM
        soft += kind == SOFT

    def close(tag: str | None) -> None:
        """Closes what is open, up to and with the innermost ``tag`` (None: everything)."""
        nonlocal main, cut_out, soft
        while stack:
            name, is_main, kind = stack.pop()
            open_[name] -= 1
            if name in HOLDERS:
                path.pop()
            if is_main or kind:
                gap()
            main -= is_main
            cut_out -= kind == FIRM
            soft -= kind == SOFT
            if name == tag:
                break

    def shut(tag: str, at: int) -> int:
        """Where the next closing tag of a raw element begins; the page's end if there is none."""
        if shuts.get(tag, -1) < at:
            found = re.compile(f"</{re.escape(tag)}", re.I | re.A).search(page, at)
            shuts[tag] = found.start() if found else len(page)
        return shuts[tag]

    at = 0
    while True:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        follow = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = len(page) if stop < 0 else stop + 3
            continue
        if follow in ("!", "?"):
            stop = page.find(">", lt)
            at = len(page) if stop < 0 else stop + 1
            continue
        m = TAG.match(page, lt) or LOOSE_TAG.match(page, lt)
        if not m:
            if page.startswith("</", lt) or follow.isascii() and follow.isalpha():
                stop = page.find(">", lt)
                at = len(page) if stop < 0 else stop + 1
            else:  # a sign, not a tag
                say("<")
                at = lt + 1
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        at = m.end()
        if tag == "br":
            say(" ")
            continue
        if tag in RAW and not closing:
            if not (attributes.endswith("/") and tag in ("svg", "math")):
                stop = shut(tag, at)
                if stop < len(page):
                    end = page.find(">", stop)
                    at = len(page) if end < 0 else end + 1
                elif tag in ("script", "style"):
                    at = len(page)
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            if not closing and attributes and not cut_out and (kind := is_boilerplate(tag, attributes, main > 0)):
                push(tag, False, kind)
            elif closing and stack and stack[-1][0] == tag:
                close(tag)
            elif not closing and stack and stack[-1][0] == tag:
                push(tag, False, 0)
            continue
        end_block()
        if closing:
            if open_[tag]:
                close(tag)
            continue
        kind = is_boilerplate(tag, attributes, main > 0)
        if tag in VOID or tag in SELF_CLOSING and not kind and not open_[tag]:
            continue
        push(tag, tag in MAIN or 'role="main"' in attributes, kind)
    end_block()
    close(None)
    return out


def stretches(weights: list[float], window: int) -> list[tuple[int, int, float]]:
    """(surge, dive, best window) of each stretch of lines in which the window's sum, taken forward from each line, stays above 0."""
    sums = [0.0]
    for w in weights:
        sums.append(sums[-1] + w)
    filled = [0]
    for w in weights:
        filled.append(filled[-1] + (w > 0))
    n, out, i = len(weights), [], 0
    while i < n:
        far = min(i + window, n)
        if filled[far] == filled[i]:
            i += 1
            continue
        j, best = i, 0.0
        while j < n and filled[far := min(j + window, n)] > filled[j]:
            best = max(best, sums[far] - sums[j])
            j += 1
        out.append((i, j, best))
        i = j
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines between surges and dives of the distribution of text over lines.

    A line weighs its characters outside links, times NAMED_WEIGHT for each name, form or
    header that it lies in, and times OUTSIDE_WEIGHT if the page has articles and it is in
    none. The distribution at a line is what it and the next ``window`` - 1 weigh. It
    surges where it leaves 0 for a stretch that reaches ``surge`` (or the page's best
    window, if that is less) and OF_BEST of the best window, and dives where it is 0
    again: among lines of links, and at the empty lines that the edges of articles and of
    what tags and names tell of leave. Such stretches, from their first to their last line
    that weighs anything, are the main text; so are all lines whose text weighs no less
    between the first and the last of them, or, if they weigh anything, of an element that
    surged, however short. In an article, and in headings, a line of links
    alone weighs 1, so that it stays.
    """
    if not page:
        return ""
    lines = page_lines(page)
    if any(x.in_main for x in lines):
        lines = [x if x.in_main or not x.text else x._replace(weight=x.weight * OUTSIDE_WEIGHT) for x in lines]
    else:
        lines = [x._replace(weight=x.weight * NAMED_WEIGHT) if len(x.text) < 200 and RIGHTS.match(x.text) else x for x in lines]
    size = [max(x.plain, int(x.in_main and x.text != "")) * x.weight for x in lines]
    found = stretches(size, window)
    if not found:
        return ""
    best = max(peak for *_, peak in found)
    high = [(a, b) for a, b, peak in found if peak >= max(min(surge, best), OF_BEST * best)]
    taken: set[int] = set()
    surged: dict[int, float] = {}  # by element: the least weight that has surged
    for a, b in high:
        while not size[a]:  # a window looks ahead
            a += 1
        while not size[b - 1]:
            b -= 1
        weight = max(lines[k].weight for k in range(a, b))
        inside = [k for k in range(a, b) if lines[k].text and lines[k].weight >= weight]
        taken.update(inside)
        for k in inside:
            surged[lines[k].element] = min(weight, surged.get(lines[k].element, weight))
    full = max(surged.values())
    first, last = min(taken), max(taken)
    return "\n".join(x.text for k, x in enumerate(lines) if x.text and (k in taken or size[k] and x.weight >= surged.get(x.element, 2.0) or first < k < last and x.weight >= full))


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All columns of pages but html_col, then text_col and n_chars (its code points).

    Null or empty html, and pages without text: empty text. Columns of the same names are
    replaced. Null urls and repeated rows are carried. Empty input: no rows. A page is
    read whole, whatever its length, in time that grows with it.
    """
    kept = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, text_col, "n_chars"])

    rows = pages.select(*kept, html_col)
    return map_batches(rows, run, ", ".join(f"`{n}` {t}" for n, t in rows.drop(html_col).dtypes) + f", `{text_col}` string, n_chars long")


def op5(spark, sf_dir: str) -> DataFrame:
    """Registered query: every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
