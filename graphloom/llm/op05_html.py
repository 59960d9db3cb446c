"""HTML extraction by line-block distribution.

Markup is stripped to lines, a line a block of text. A line's length is its text, outside of articles without that of links; lines
of menus, headers, footers, sidebars, notices, adverts, forms and comments have none, nor have lines that are mostly links. The
lengths are summed over sliding windows of lines: text begins where a window surges over the threshold and ends where
windows dive to nothing. A surge takes the lines that adjoin it, too, and where it lies in an element that the page
marks as an article or its main part, that element's beginning and end are the surge's and the dive's points: short first
and last lines are of the article then. What has no surge is not kept, marked or not. The scan of a page is linear; there is no shuffle.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import keep_columns, slices, table

MADE = ["text", "n_chars"]
#: Lines of a window, the characters at which it surges (the most of any window, if that is less), and the share of link text that makes a line a menu's.
WINDOW, SURGE, LINKS = 3, 80, 0.5

# fixed values: elements by their part in a page
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_OUT = frozenset("script style noscript template head title nav footer aside form button select textarea iframe svg canvas object audio video dialog menu datalist".split())
_MAIN = frozenset(("article", "main"))
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments discussion disqus reply replies respond pagination pager toolbar widget skip hidden".split()
)
_NAME_START = frozenset("/ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Za-z]+")


class _Node:
    """An element; mark: the outermost article or main part that it is in or is."""

    __slots__ = ("cleared", "left", "mark", "out", "tag", "up")

    def __init__(self, tag: str, up: _Node | None, out: bool):
        self.tag, self.up, self.out = tag, up, out
        self.mark = up and up.mark or (self if tag in _MAIN else None)
        self.cleared, self.left = False, None


def _named_out(attrs: str, inside: bool) -> bool:
    """By role, hidden state, or a class or id that is a name of the list, or begins or ends with one."""
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in _ROLES:
            return True
        if key in ("class", "id"):
            for name in value.split():
                parts = _PARTS.findall(name)
                if parts and parts[0] not in ("has", "no", "with", "without", "is", "non", "main", "article", "content", "entry", "post") and {parts[0], parts[-1]} & (_NAMES - {"header"} if inside else _NAMES):
                    return True
                if len(parts) > 1 and parts[-1] in ("ad", "ads", "comments", "sidebar", "footer", "nav", "menu", "share", "related"):
                    return True
    return False


def _lines(page: str) -> list[tuple[str, int, _Node]]:
    """(text, characters of it in links, node) of each block with text, in page order."""
    node = _Node("", None, False)
    found: list[tuple[str, int, _Node]] = []
    parts: list[tuple[str, bool]] = []
    link, at, n, tags = 0, 0, len(page), _TAG
    opened: Counter[str] = Counter()
    marked = False

    last = page.rfind(">")

    def flush() -> None:
        if parts:
            words = " ".join("".join(p for p, _ in parts).split())
            if words:
                found.append((words, len(" ".join("".join(p for p, k in parts if k).split())), node))
            parts.clear()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            parts.append((_html.unescape(page[at:lt]), link > 0))
        at = lt
        if at >= n:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = tags.match(page, at) if last > at else None
        if not m and tags is _TAG and last > at and page[at + 1 : at + 2].isalpha():
            tags = _PLAIN_TAG  # a quote stays open to the end of the page: from here on > ends a tag
        if not m and page[at + 1 : at + 2] in _NAME_START and last > at:
            m = tags.match(page, at)
        if not m:
            parts.append(("<", link > 0))
            at += 1
            continue
        at, close, tag = m.end(), m[1], m[2].lower()
        if tag in _BLOCK:
            flush()
        if tag == "a":
            link = 0 if close else 1
        if close:
            if opened[tag]:  # elements left open inside it end too
                while node.tag != tag:
                    opened[node.tag] -= 1
                    node = node.up
                opened[tag] -= 1
                node = node.up
            continue
        if tag == "p" and node.tag == "p" or tag in ("li", "option", "tr", "td", "th", "dt", "dd") and node.tag == tag:
            opened[tag] -= 1
            node = node.up
        if tag in _VOID:
            continue
        out = tag in _OUT or tag == "header" and not node.mark or tag not in ("html", "body", "main") and _named_out(m[3], bool(node.mark) or tag == "article")
        new = _Node(tag, node, out)
        if tag in _MAIN and not out and not marked:  # what holds the first article is no menu, whatever its name, nor is one that was left open before it
            marked, up = True, node
            while up is not None and not up.cleared:
                up.cleared = True
                if up.out and up.tag not in ("aside", "noscript", "template"):
                    up.out = False
                up = up.up
        if tag in _RAW and not m[3].endswith("/"):
            end = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(page, at)
            at = n if end is None else max(page.find(">", end.end()) + 1, end.end())
            continue
        if not m[3].endswith("/"):
            node = new
            opened[tag] += 1
    flush()
    return found


def _left_out(node: _Node | None) -> bool:
    """Whether the node or one above it is out; kept on the way, so a page costs its nodes once."""
    way = []
    while node is not None and node.left is None:
        way.append(node)
        node = node.up
    left = node.left if node is not None else False
    for x in reversed(way):
        left = x.left = left or x.out
    return left


def windows(length: list[int]) -> list[int]:
    """The sums of each line's length and the next ones', WINDOW lines in all."""
    return [sum(length[i : i + WINDOW]) for i in range(len(length))]


def main_text(page: str | None) -> str:
    r"""The article's blocks joined by \n; "" of a null or empty page, or one without text."""
    lines = _lines(page or "")
    open_ = [not _left_out(node) for *_, node in lines]
    inside = lambda t, k, node: len(t) if node.mark else len(t) - k if k <= LINKS * len(t) else 0  # noqa: E731  links in an article are its text
    length = [inside(*line) if ok else 0 for ok, line in zip(open_, lines, strict=True)]
    sums = windows(length)
    surge = min(SURGE, max(sums, default=0)) or 1
    # lines from a surge to its dive
    kept, going = [False] * len(lines), False
    for i, total in enumerate(sums):
        going = total >= surge or going and total > 0
        kept[i] = going and length[i] > 0
    for i in range(len(lines) - 2, -1, -1):  # and those that lead to it without a gap
        kept[i] = kept[i] or kept[i + 1] and length[i] > 0
    marks = {id(node.mark) for size, total, (*_, node) in zip(length, sums, lines, strict=True) if size and total >= surge and node.mark}
    if marks:
        kept = [ok and id(node.mark) in marks for ok, (*_, node) in zip(open_, lines, strict=True)]
    return "\n".join(t for k, (t, *_) in zip(kept, lines, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """pages with text (the main text of html) and n_chars (its code points).

    Character references are decoded, white space inside a block is one space, blocks are in page order.
    A null or empty page has the text "". Repeated rows come back as often; a null page_id or url stays.
    Columns of the names made are replaced.
    """
    base = keep_columns(pages, MADE)
    schema = base.withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches):
        for b in slices(batches):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*b.schema.names, *MADE])

    return base.mapInArrow(run, schema)


def query(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
