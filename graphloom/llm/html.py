"""HTML extraction by tree scoring.

Paragraphs give points for their length and commas to the elements above them, elements lose them again by the share
of their text that stands in links, and the best container is kept with those siblings that score alike, and with the
other articles of the page.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are suspected by element, role or whole
class name, and left out where the prose around them stands elsewhere: an element around the article is not left out for its
name, a part of an article is measured by the article alone. Elements and names that are never around an article (menus,
footers, adverts) are left out wherever there is other text, however large they are. Sections of one container belong
together. Reading a page takes time in proportion to its length, however deep or broken its elements are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element, role and class names.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
BLOCKS = frozenset(
    (
        "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3",
        "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th",
        "thead", "title", "tr", "ul",
    )
)
NO_TEXT = frozenset(
    (
        "audio", "button", "canvas", "embed", "head", "iframe", "input", "map", "noembed", "noframes", "noscript", "object", "optgroup", "option", "script", "select", "style", "svg", "template", "textarea", "title", "video", "xmp",
    )
)
SUSPECT = frozenset(("aside", "dialog", "fieldset", "footer", "form", "header", "menu", "nav", "search"))
SUSPECT_ROLES = frozenset(("alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"))
COMMENT_NAMES = frozenset(("comment", "comments", "commentlist", "disqus", "replies", "respond", "responses"))
SUSPECT_NAMES = COMMENT_NAMES | frozenset(
    (
        "ad", "ads", "adsense", "advert", "adverts", "advertisement", "alert", "announcement", "banner", "breadcrumb", "breadcrumbs", "byline-share", "consent", "cookie", "cookies", "flash", "footer", "gdpr", "header", "login",
        "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "paywall", "popup", "promo", "promoted", "promotion", "recommended", "related", "search",
        "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "warning", "widget",
    )
)
#: Elements and names that have no article inside: left out, whatever their size, where a page has other text.
CHROME = frozenset(("aside", "dialog", "footer", "menu", "nav", "search"))
ADVERTS = frozenset(("ad", "ads", "adsense", "advert", "adverts", "advertisement", "consent", "cookie", "cookies", "gdpr", "newsletter", "promo", "promoted", "promotion", "sponsor", "sponsored", "subscribe", "subscription"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words that turn a class name into a statement about the page, and words for what a part is made as.
STATES = frozenset(("as", "has", "hide", "in", "is", "js", "no", "not", "on", "show", "under", "with", "without"))
SHAPES = frozenset(("area", "bar", "block", "box", "buttons", "container", "form", "items", "links", "list", "message", "overlay", "panel", "section", "strip", "wrap", "wrapper"))
GOOD_NAMES = frozenset(("article", "body", "blog", "content", "entry", "main", "page", "post", "story", "text"))
POINTS = {"article": 25, "main": 25, "section": 8, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "dd": -3, "dt": -3, "th": -5}
CLOSES_P = BLOCKS - {"br", "option", "optgroup", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "body", "html", "head", "title"}
CLOSES_ITSELF = frozenset(("li", "dd", "dt", "tr", "td", "th", "option"))
OPEN_TO_CLOSE = frozenset(("p", "tr", "td", "th"))
LEAVES = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "td", "th", "pre", "blockquote", "figcaption", "caption", "summary"))
#: A paragraph counts from so many characters; siblings stay from such a share of the best score.
LEAST_CHARS, SIBLING_SHARE, SIBLING_LEAST = 25, 0.2, 10
#: A suspect stays if it holds such a share of the page's prose, or of the article's that it is a part of (for reader
#: comments: all but a twentieth). A further article counts from such a share of the prose of the best container.
WRAPPER_SHARE, COMMENT_SHARE, ARTICLE_SHARE = 5 / 6, 0.95, 0.2
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"""([^\s=/"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")


def tags(page: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(text before, slash, name, attributes) of each tag as (text, slash + name, attributes, start, end), in order; a tag
    without a closed quote ends at the next ">", comments and declarations are left out, raw elements have no tags."""
    at = low = 0
    quotes = True
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            comment = page.startswith("<!--", at)
            end = page.find("-->" if comment else ">", at + 2)
            yield page[low:at], "", "", at, at
            at = low = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        m = TAG.match(page, at) if quotes else None
        if m:
            slash, name, attributes, end = m[1], m[2], m[3], m.end()
        else:
            m = NAME.match(page, at)
            if not m:
                at += 1
                continue
            quotes = False  # from here on a quote may lack its end: looking for it again and again would take squared time
            end = page.find(">", m.end()) + 1
            if not end:
                break
            slash, name, attributes = m[1], m[2], page[m.end() : end - 1]
        name = name.lower()
        yield page[low:at], slash + name, attributes, at, end
        at = low = end
        if not slash and name in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = low = close.start() if close else len(page)
    yield page[low:], "", "", len(page), len(page)


def suspected(names: str, of: frozenset = SUSPECT_NAMES) -> bool:
    """Whether a class or id is one of the names, ends with one (site-footer) or begins with one and goes on with a shape
    (share-buttons); not where it only says something about the page (has-menu)."""
    for name in names.split():
        parts = name.replace("_", "-").split("-")
        if name in of or parts[0] not in STATES and (parts[-1] in of or parts[0] in of and parts[-1] in SHAPES):
            return True
    return False


class Tree:
    """Elements by number in page order: parent, tag, the block around each, the suspicion that it has raised ("", "element",
    "part", "comment", "chrome" for what has no article inside; "never" for what has no text), name weight, and the article
    around it; and the text blocks."""

    def __init__(self, page: str):
        self.parent, self.tag, self.block, self.doubt, self.weight, self.article = [-1], ["#root"], [0], [""], [0], [0]
        self.blocks: list[list] = []  # [element, pieces, characters in links]
        self._open, self._where, self._walls, self._blocks = [0], {}, [0], [0]
        self._links, self._fresh = 0, True
        for text, tag, attributes, _, _ in tags(page):
            if text:
                self._text(text)
            if tag[:1] == "/":
                self._end(tag[1:])
            elif tag:
                self._start(tag, attributes)

    def _text(self, raw: str) -> None:
        node = self._open[-1]
        if self.doubt[node] == "never":
            return
        text = html.unescape(raw) if "&" in raw else raw
        if self._fresh:
            if text.isspace():
                return
            self.blocks.append([self.block[node], [], 0])
            self._fresh = False
        self.blocks[-1][1].append(text)
        if self._links:
            self.blocks[-1][2] += len(text)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._fresh = True
            if tag in CLOSES_P:
                self._close("p")
            if tag in CLOSES_ITSELF:
                self._close(tag)
        if tag in VOID:
            return
        above, node = self._open[-1], len(self.tag)
        given = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes and not attributes.isspace() else {}
        names = f"{given.get('class', '')} {given.get('id', '')}".lower()
        self.parent.append(above)
        self.tag.append(tag)
        self.block.append(node if tag in BLOCKS else self.block[above])
        self.doubt.append(self._doubt(above, tag, names, given))
        words = set(names.replace("-", " ").replace("_", " ").split())
        self.weight.append(POINTS.get(tag, 0) + (25 if words & GOOD_NAMES else 0))
        self.article.append(node if tag in ("article", "main") else self.article[above])
        if not attributes.endswith("/") or tag in BLOCKS:
            place = len(self._open)
            self._open.append(node)
            self._where.setdefault(tag, []).append(place)
            if tag in BLOCKS:
                self._blocks.append(place)
                if tag not in OPEN_TO_CLOSE:
                    self._walls.append(place)
            self._links += tag == "a"

    def _doubt(self, above: int, tag: str, names: str, given: dict[str, str]) -> str:
        if self.doubt[above] == "never" or tag in NO_TEXT:
            return "never"
        if tag in ("html", "body"):
            return ""
        if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
            return "never"
        if names.strip() and suspected(names, COMMENT_NAMES):
            return "comment"
        if tag in ("article", "main"):
            return ""
        if tag == "header" and self.article[above]:  # the head of an article holds its title
            return ""
        if tag in CHROME or names.strip() and suspected(names, ADVERTS):
            return "chrome"
        if tag in SUSPECT or given.get("role", "").lower() in SUSPECT_ROLES:
            return "element"
        return "part" if names.strip() and suspected(names) else ""

    def _pop(self, to: int) -> None:
        while len(self._open) > to:
            tag = self.tag[self._open.pop()]
            self._where[tag].pop()
            self._links -= tag == "a"
            for places in (self._blocks, self._walls):
                if places[-1] == len(self._open):
                    places.pop()

    def _close(self, tag: str) -> None:
        """Ends an open element that the one to come ends without an end tag; not beyond its list, table or container."""
        place = self._where.get(tag) or [0]
        wall = self._walls[-1]
        if place[-1] and place[-1] >= wall:
            self._pop(place[-1])

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._fresh = True
        place = self._where.get(tag) or [0]
        if place[-1] and (tag in BLOCKS or place[-1] > self._blocks[-1]):
            self._pop(place[-1])


def main_text(page: str | None) -> str:
    """The text of the main container of a page; empty where there is none."""
    if not page:
        return ""
    tree = Tree(page)
    blocks = [(b[0], t, b[2]) for b in tree.blocks if (t := " ".join("".join(b[1]).split()))]
    if not blocks:
        return ""
    n, parent, tag = len(tree.tag), tree.parent, tree.tag
    under = [False] * n  # of a suspect
    for x in range(1, n):
        under[x] = under[parent[x]] or bool(tree.doubt[x])
    chars, linked, prose, told, clean, articles = ([0] * n for _ in range(6))  # prose: paragraphs that count; told: those in articles; clean: text out of links and suspects
    for holder, text, links in blocks:
        chars[holder] += len(text)
        linked[holder] += min(links, len(text))
        clean[holder] += 0 if under[holder] else len(text) - min(links, len(text))
        if len(text) >= LEAST_CHARS and 2 * links < len(text):
            prose[holder] += len(text)
            told[holder] += len(text) if tree.article[holder] else 0
    for x in range(1, n):
        articles[x] = int(tag[x] in ("article", "main"))
    for own in (chars, linked, prose, told, clean, articles):
        for x in range(n - 1, 0, -1):  # children come after their parents
            own[parent[x]] += own[x]
    density = lambda x: linked[x] / chars[x] if chars[x] else 0.0
    plain = [c - k for c, k in zip(chars, linked, strict=True)]
    whole = told if told[0] else prose if prose[0] else plain  # what a page is measured by: pages without paragraphs by all text
    out = [False] * n
    for x in range(1, n):
        doubt, around = tree.doubt[x], tree.article[parent[x]]
        if out[parent[x]]:
            out[x] = True
        elif doubt == "chrome" and not articles[x] and (clean[0] or chars[x] < chars[around]):
            out[x] = True
        elif doubt in ("part", "chrome") and around and not out[around]:
            mine = prose if prose[around] else plain
            out[x] = mine[x] < WRAPPER_SHARE * mine[around] or not mine[around]
        elif doubt:
            out[x] = whole[x] < (COMMENT_SHARE if doubt == "comment" else WRAPPER_SHARE) * whole[0] or not whole[0]
    points, scored = [0.0] * n, set()
    for holder, text, _ in blocks:
        if len(text) >= LEAST_CHARS and not out[holder]:
            near = parent[holder] if tag[holder] in LEAVES else holder
            gain = 1 + text.count(",") + min(len(text) // 100, 3)
            for x, share in ((near, 1.0), (parent[near] if near > 0 else -1, 0.5)):
                if x > 0:
                    points[x] += share * gain
                    scored.add(x)
    scored |= {x for x in range(1, n) if tag[x] in ("article", "main") and chars[x]}
    score = {x: (points[x] + tree.weight[x]) * (1 - density(x)) for x in scored if not out[x]}
    best = max(score, key=lambda x: (score[x], -x), default=0)
    best = tree.article[best] or best  # sections and divisions of one article belong together
    children: list[list[int]] = [[] for _ in range(n)]
    for y in range(1, n):
        if chars[y] and not out[y]:
            children[parent[y]].append(y)
    sections = lambda x: [y for y in children[parent[x]] if tag[y] == "section"] if tag[x] == "section" else []
    while len(sections(best)) > 1 and tag[parent[best]] not in ("body", "html", "#root"):
        best = tree.article[parent[best]] or parent[best]  # so do sections of one container
    roots = {best}
    if len(together := sections(best)) > 1:
        roots |= {*together, *(y for y in children[parent[best]] if tag[y] in HEADINGS)}
    least = max(SIBLING_LEAST, SIBLING_SHARE * score.get(best, 0.0))
    for y in range(1, n):
        if y == best or out[y] or not chars[y]:
            continue
        if tag[y] == "article" and density(y) < 0.5 and prose[y] >= ARTICLE_SHARE * prose[best]:
            roots.add(y)
        elif best > 0 and tag[best] != "body" and parent[y] == parent[best]:
            plain_text = tag[y] == "p" and (chars[y] > 80 and density(y) < 0.25 or chars[y] <= 80 and not linked[y])
            if tag[y] != "article" and score.get(y, 0.0) >= least or plain_text:
                roots.add(y)
    inside = [False] * n
    for y in range(n):
        inside[y] = not out[y] and (y in roots or parent[y] >= 0 and inside[parent[y]])
    return " ".join(text for holder, text, _ in blocks if inside[holder])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of the whole html of every row.

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
    one space. Null, empty and text-free pages give an empty text; unclosed and stray tags are read as browsers do in
    the main, pages of any length and depth in time in proportion to their length; rows are independent, so repeated
    rows give repeated results; an empty table gives an empty result.
    """
    types = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
