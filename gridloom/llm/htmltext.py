"""Main text of web pages by line-block distribution.

Markup is stripped: scripts, styles and comments, and elements that hold menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, known by element, role, or class and id. A class or id counts as a whole: all its
words must be hints or say no more than a place or a kind of box (`ad`, `site-footer`, `share-buttons`), so that names
such as `share-your-story` don't. What is left falls into lines at block elements; inline elements and line breaks don't
end a line. Where something was stripped or a sectioning element begins or ends, blank lines keep neighbours apart. The
text lengths (without linked text) are summed over sliding windows of WINDOW lines: a line where the sum rises from zero
is a surge point, a line where it is back at zero a dive point, and the text between a surge and its dive is a hill.

Where such an article or main element (one that is not stripped itself) has a hill whose highest window is at least SHARE of
the page's highest, all lines in it are kept, as what is stripped inside cuts an article into hills of any size. On other pages the first and the last hill whose highest window is
at least SHARE of the page's highest mark the main text, and what lies between that surge and that dive point is kept,
short lines included, but for hills of several lines that are mostly links without sentences. Before and after it, hills
are kept that are no such links and don't speak like a notice (copyright, cookies, signing up).

Cases: null html counts as empty; a page without text gives an empty text; unclosed elements end with their parents and
an unclosed boilerplate element is not stripped; an unclosed comment or declaration goes on to the end of the page; html
without any tag is one line; pages of any size are taken whole, in time that grows with their length; repeated rows give
the same text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, text_batches

WINDOW = 4
SHARE = 0.15

#: Elements of HTML by their part in a page.
DROPPED = frozenset("script style noscript template svg math head title nav aside form button select textarea iframe object embed canvas audio video dialog menu footer header".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SECTION = frozenset("article main section div body table ul ol dl blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar form".split())
HINTS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice banner alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus reply replies respond share sharing social "
    "related recommended newsletter subscribe subscription signup login widget toolbar pagination pager form search skip".split()
)
#: Words that may stand beside a hint in a class or id.
PLACES = frozenset(
    "site page main top bottom left right upper lower global primary secondary inner outer first last sticky fixed mobile desktop "
    "box block bar area container wrapper wrap holder panel section slot unit zone row col column group content inline "
    "list links link item items button buttons icons icon media posts post stories text title label message info policy law "
    "here us by bg img image logo div the and js user users reader readers visitor thread threads warning cta teaser tracker placeholder "
    "module component element view body count field input submit close open toggle hidden visible active default theme custom new legal "
    "eu dismiss accept full width large small medium mini max min horizontal vertical floating fluid responsive static latest popular "
    "trending article articles story stories news reading topics network slider strip x px id".split()
)
#: Of the hints, those that may stand on a part of an article itself.
INSIDE = frozenset("header form notice alert".split())

#: What notices outside the main text say.
_NOTICE = re.compile(r"©|\(c\) ?\d{4}|copyright|all rights reserved|cookie|privacy policy|terms of (?:use|service)|subscribe|newsletter|sign up|log ?in\b", re.I)
_SENTENCE = re.compile(r"[.!?…。！？:;\"”»)]$")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "template", "noscript", "svg", "iframe")}


def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    if tag in DROPPED and not (inside and tag == "header"):
        return True
    if tag in ("html", "body", "article", "main") or "=" not in attributes:
        return False
    for name, *values in _ATTR.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() == "role":
            if value.lower() in ROLES:
                return True
        else:
            for name in value.split():
                parts = {x.lower() for x in _PART.findall(name)}
                hints = parts & HINTS
                if (hints - INSIDE or hints and not inside) and parts <= HINTS | PLACES:
                    return True
    return False


def page_lines(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, characters of linked text, counts) of each line, blank ones included, and whether the page has an article, so
    that only its lines count."""
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    linked = 0
    in_link = depth = 0
    skip, level = "", 0
    unclosed: set[str] = set()  # tags without an end from some place on have none later either

    def end(blank: int) -> None:
        nonlocal linked
        line = " ".join(entities.unescape("".join(text)).split())
        if line:
            out.append((line, linked, depth > 0))
        out.extend([("", 0, False)] * blank)
        text.clear()
        linked = 0

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if not skip and stop > at:
            part = page[at:stop]
            text.append(part)
            if in_link:
                linked += len(part.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if skip:
            if tag == skip and not m[3].endswith("/"):
                level += -1 if closing else 1
                if not level:
                    skip = ""
            continue
        if not closing and tag in _RAW and not m[3].endswith("/"):
            over = None if tag in unclosed else _RAW[tag].search(page, at)
            if not over:
                unclosed.add(tag)
            at = over.end() if over else len(page) if tag in ("script", "style") else at
            continue
        if not closing and not m[3].endswith("/") and tag not in unclosed and _boilerplate(tag, m[3], depth > 0):
            if re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at):
                end(WINDOW)
                skip, level = tag, 1
                continue
            unclosed.add(tag)
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK or tag in DROPPED:
            end(1 if tag in SECTION else 0)
            in_link = 0
        if tag in ("article", "main"):
            depth = max(0, depth - 1) if closing else depth + 1
    end(0)
    has_article = any(inside for _, _, inside in out)  # of those that were entered: others stand in comments or stripped elements
    return out if has_article else [(t, k, t != "") for t, k, _ in out], has_article


def main_text(page: str | None) -> str:
    lines, in_article = page_lines(page or "")
    article = [t for t, _, inside in lines if t and inside]
    within = [inside for _, _, inside in lines]
    lines = [(t, k, t != "") for t, k, _ in lines]
    weight = [max(0, len(t) - k) if inside else 0 for t, k, inside in lines]
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    hills: list[tuple[int, list[int]]] = []
    for i, (t, _, inside) in enumerate(lines):
        if not sums[i] and not (t and inside):
            continue
        if i == 0 or not (sums[i - 1] or lines[i - 1][0] and lines[i - 1][2]):
            hills.append((0, []))  # a surge point; the hill goes on to its dive point
        peak, members = hills[-1]
        hills[-1] = max(peak, sums[i]), members
        if t and inside:
            members.append(i)
    top = max((peak for peak, _ in hills), default=0)
    high = [k for k, (peak, _) in enumerate(hills) if top and peak >= SHARE * top]
    if in_article and (not high or any(within[i] for k in high for i in hills[k][1])):
        return "\n".join(article)
    kept: list[int] = []
    for k, (_, members) in enumerate(hills):
        linked = 2 * sum(lines[i][1] for i in members) > sum(len(lines[i][0]) for i in members) and 2 * sum(bool(_SENTENCE.search(lines[i][0])) for i in members) < len(members)
        if high and high[0] <= k <= high[-1]:
            drop = linked and len(members) > 1 and k not in high
        else:
            drop = bool(high) and (linked or any(_NOTICE.search(lines[i][0]) for i in members))
        if not drop:
            kept += members
    return "\n".join(lines[i][0] for i in kept)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    text_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {dict(pages.dtypes)[id_col]}, `{url_col}` string, text string, n_chars bigint")
