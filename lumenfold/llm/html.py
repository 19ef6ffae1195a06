"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by role, and name parts that mark boilerplate containers.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "canvas", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "head", "select", "button", "search",
}
OUT = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "head", "fieldset", "search", "header"}
BAD_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "cookie", "cookies", "consent", "disqus", "footer", "form",
    "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "recommended", "reply", "replies", "respond", "share", "sharing",
    "sidebar", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "alert", "paywall", "login", "signup", "skip", "copyright", "legal", "meta", "tags",
}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Names of other texts than the page's own: only these mark an article, and an article inside does not undo them.
OTHERS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "comment", "commentlist", "comments", "disqus", "promo", "promoted", "recommended", "related", "replies", "reply", "sponsor", "sponsored",
}
#: Words that follow a name for a part of a page, first words of topic and layout classes, and words that turn a name round.
PARTS = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "content", "form", "group", "holder", "icons", "inner", "item", "items", "left", "link", "links", "list", "message",
    "outer", "overlay", "panel", "popup", "posts", "right", "row", "section", "slot", "text", "top", "unit", "widget", "widgets", "wrap", "wrapper", "zone",
}
TOPICS = {"cat", "category", "format", "layout", "tag", "template", "theme", "topic", "type"}
UNLIKE = {"has", "hide", "no", "not", "with", "without"}
GOOD = {"article", "main"}
#: Frequent function words (fixed values): English, German, French, Spanish.
STOP = set(
    "a an and are as at be by for from has have he in is it its not of on or that the their they this to was were which will with you what "
    "auf aus das dem den der des die ein eine einer er für im in ist mit nicht sich sie und von zu auch als an "
    "au aux avec ce ces dans de des du elle en est et il la le les ne pas pour qui que sur un une ou par "
    "al con como de del el en es la las lo los no o para por que se su sus un una y más mi".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAME = re.compile(r"[a-z]+")
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of scripts without spaces between words (Thai, Lao, Khmer, Burmese, kana, Han): so many count as a word.
UNSPACED, LETTERS_A_WORD = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"), 2
#: Pass one: a block with more of its characters in links is bad; one of few words is undecided; a long one is main text by stop words, or by length alone
#: if few of its characters are in links or the page is in no language of STOP; stop words decide one between.
MOST_LINKS, FEW_LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.5, 0.2, 10, 30, 0.05, 0.2
UNCLOSED = {"p", "li", "dd", "dt", "option", "td", "th", "tr", "thead", "tbody", "tfoot"}


def _named(value: str, article: bool, inside: bool) -> str | None:
    """The name that marks a class or id as boilerplate: a token that is one, or a compound with one as its head or before a part of a page."""
    found = None
    for token in value.split():
        parts = NAME.findall(token)
        if not parts or inside and set(parts) & {"header", "title", "meta", "headline"} or parts[0] in TOPICS or set(parts) & UNLIKE:
            continue
        if parts[-1] in BAD_NAMES and (len(parts) == 1 or not article):
            name = parts[-1]
        elif parts[0] in BAD_NAMES and parts[-1] in PARTS and not article:
            name = parts[0]
        else:
            continue
        if name in OTHERS:
            return name
        found = None if article else name
    return found


def _boilerplate(name: str, attributes: str, article: bool, inside: bool) -> tuple[bool, str | None]:
    """Whether an element holds no main text, and the name in its class or id that says so. A header inside an article is part of it."""
    if name in OUT and not (name == "header" and inside):
        return True, None
    if not attributes or name in ("html", "body"):
        return False, None
    named = None
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            new = _named(value, article, inside)
            named = new if new in OTHERS else named or new
        elif key == "role" and value in BAD_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True, None
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, None
    return False, named


class Block:
    __slots__ = ("text", "links", "where")

    def __init__(self, text: str, links: int, where: int):
        self.text, self.links, self.where = text, links, where


class Mark:
    """An element that is boilerplate by its class or id, until an article or main element inside undoes that."""

    __slots__ = ("name", "undone")

    def __init__(self, name: str):
        self.name, self.undone = name, False


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. ``where``: -1 inside boilerplate, 1 inside an article or main element, else 0."""
    out: list[Block] = []
    under: list[tuple[Block, list[Mark]]] = []
    open_: list[tuple[str, bool, bool, bool]] = []  # name, whether it is boilerplate, whether it is an article, whether it has a mark
    marks: list[Mark] = []
    bad = good = links = linked = 0
    parts: list[str] = []

    def close() -> str:
        nonlocal bad, good
        name, b, g, marked = open_.pop()
        bad, good = bad - b, good - g
        if marked:
            marks.pop()
        return name

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, linked, -1 if bad else 1 if good else 0))
            if marks and not bad:
                under.append((out[-1], marks.copy()))
        parts.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            parts.append(page[at:lt])
            linked += links and len(page[at:lt].strip())
        if lt == n:
            break
        m = TOKEN.match(page, lt)
        if not m:
            parts.append("&lt;")
            at = lt + 1
            continue
        at = m.end()
        if m[1] is not None:
            parts.append(m[1].replace("&", "&amp;"))
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if name in BLOCKS:
                flush()
            elif name == "a":
                links = max(0, links - 1)
            if any(x[0] == name for x in open_):
                while close() != name:
                    pass
            continue
        if name in RAW:
            if not m[4].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        elif name == "a":
            links += 1
            continue
        if name in VOID:
            continue
        while open_ and name in UNCLOSED and open_[-1][0] == name:
            close()
        main = name == "main" or 'role="main"' in m[4].lower()
        g = main or name in GOOD or "articlebody" in m[4].lower()
        b, named = _boilerplate(name, m[4], g, good > 0)
        if (b or named) and name not in BLOCKS:
            flush()
        if g and not (b or named or bad):
            for mark in reversed(marks):
                if not main and mark.name in OTHERS:
                    break
                mark.undone = True
        open_.append((name, b, g, named is not None))
        bad, good = bad + b, good + g
        if named:
            marks.append(Mark(named))
    flush()
    for block, held in under:
        if not all(mark.undone for mark in held):
            block.where = -1
    return out


def classify(found: list[Block]) -> list[bool]:
    """Which blocks are main text.

    Pass one: link density, length and stop-word density decide; inside boilerplate a block never is. Lists of stop words are of four languages,
    and code and tables have few, so their lack rejects nothing. Pass two: an undecided block takes
    the label of the nearest decided neighbours outside boilerplate (both sides if they agree; else main text inside an article, and outside one the
    nearer, main text on a tie); without any, it is main text. An article or main element decides nothing else.
    """
    labels: list[bool | None] = []
    words = [[x.lower() for x in LETTERS.findall(b.text)] if b.where >= 0 else [] for b in found]
    stops = [sum(w in STOP for w in x) for x in words]
    known = sum(stops) >= STOP_LOW * sum(map(len, words))
    for b, x, s in zip(found, words, stops, strict=True):
        density = b.links / max(1, len(b.text))
        length = len(x) if b.text.isascii() else len(x) + len(UNSPACED.findall(b.text)) // LETTERS_A_WORD
        if b.where < 0:
            labels.append(False)
        elif density > MOST_LINKS:
            labels.append(False)
        elif length < SHORT:
            labels.append(None)
        elif length < LONG:
            labels.append(True if s >= STOP_HIGH * len(x) > 0 else None)
        else:
            labels.append(True if density <= FEW_LINKS or not known or s >= STOP_LOW * len(x) > 0 else None)
    n = len(found)
    before: list[tuple[int, bool] | None] = [None] * n
    last = None
    for i, x in enumerate(labels):
        before[i] = last
        last = (i, x) if x is not None and found[i].where >= 0 else last
    out, nxt = [False] * n, None
    for i in range(n - 1, -1, -1):
        x = labels[i]
        if x is None:
            a, b = before[i], nxt
            if a and b and a[1] != b[1]:
                out[i] = found[i].where > 0 or (a[1] if i - a[0] < b[0] - i else b[1] if b[0] - i < i - a[0] else True)
            else:
                out[i] = (a or b or (0, True))[1]
        else:
            out[i] = x
            nxt = (i, x) if found[i].where >= 0 else nxt
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return " ".join(b.text for b, ok in zip(found, classify(found), strict=True) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, from its whole html.

    A null or empty html gives an empty text; broken markup is read as far as it goes. Nulls in id or url pass through, repeated rows are read
    each, other columns are not read; an empty table gives no rows.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return out.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
