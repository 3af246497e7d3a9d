"""Main text of web pages by composite text density.

The tree of a page is built without the elements that never hold article text, by
their meaning (navigation, forms, scripts) or, for blocks other than paragraphs, by
a name that says so. Each node's density is its characters per tag, weighed by how
much of them stands in links; a node's sum is that of its children's densities. The
node of the greatest sum lies in the article. The least density on the path from the
body to it is the threshold: the highest ancestor on the path that adds only content
of at least that density, or headings and paragraphs, is the article.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import text_of

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements whose whole content is no article text.
DROP = frozenset("script style noscript template iframe object embed svg canvas math head title form button select option textarea input label fieldset nav aside footer menu dialog audio video map noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: tag: open tags that it closes, and those beyond which it doesn't look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Words of class names, ids and roles that mark what stands around an article.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist disqus replies respond consent cookie cookies gdpr footer footnav header masthead "
    "topbar menu menubar nav navbar navigation navigation pager pagination sidebar sidebars widget widgets notice notices alert popup modal overlay promo promos promotion related recommended recommendations "
    "share sharing social sponsor sponsored sponsors subscribe subscription newsletter signup login search toolbar tags taglist skip skiplink contentinfo complementary".split()
)
SPLIT_NAME = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Words that go with those.
BESIDE = frozenset("area articles bar block bottom box center col column container content group inner item items left links list main nav page post posts entry blog article right section site stories text title top widget wrap wrapper".split())
#: Elements whose names are not believed: an article's own text has them too.
OWN_TEXT = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Beyond so many levels a page's elements count as text of the deepest one.
DEEPEST = 500


def _named_around(name: str, in_article: bool) -> bool:
    """Whether one class name, id or role says that a block stands around an article, and nothing else."""
    words = {w.lower() for w in SPLIT_NAME.split(name) if w}
    said = words & AROUND
    if in_article:
        said -= {"header"}
    return bool(said) and all(w in AROUND or w in BESIDE or w.isdigit() for w in words)


def _around(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element stands around an article. A header inside one holds its title."""
    if tag == "header" and not in_article:
        return True
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role") and tag not in OWN_TEXT and any(_named_around(x, in_article) for x in value.split()):
            return True
    return False


class Page:
    """Nodes in page order: parent, tag, and counts of a node's own subtree."""

    def __init__(self, source: str, by_name: bool = True):
        self.by_name = by_name
        self.tag, self.parent, self.tags, self.chars, self.link_tags, self.link_chars = ["#page"], [-1], [0], [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []  # node, text; an empty text is a border between blocks
        self._read(source)
        for i in range(len(self.tag) - 1, 0, -1):
            p = self.parent[i]
            self.tags[p] += self.tags[i] + 1
            self.chars[p] += self.chars[i]
            self.link_tags[p] += self.link_tags[i] + (self.tag[i] == "a")
            self.link_chars[p] += self.chars[i] if self.tag[i] == "a" else self.link_chars[i]

    def _read(self, source: str) -> None:
        open_: list[tuple[str, int]] = [("#page", 0)]  # tag, node; -1 inside of dropped content
        self.opened: Counter = Counter()  # open elements by tag
        at, end = 0, len(source)
        while at < end:
            m = TAG.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                self._text(open_[-1][1], source[at:stop])
            if not m:
                return
            at = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    self._text(open_[-1][1], m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(open_, tag)
                continue
            at = self._start(open_, tag, m[3], source, at)

    def _text(self, node: int, text: str) -> None:
        if node >= 0:
            text = html.unescape(text) if "&" in text else text
            self.pieces.append((node, text))
            self.chars[node] += len("".join(text.split()))

    def _border(self, node: int) -> None:
        if node >= 0:
            self.pieces.append((node, ""))

    def _pop(self, open_: list, to: int) -> None:
        while len(open_) > to:
            tag, _ = open_.pop()
            self.opened[tag] -= 1
            if tag not in INLINE:
                self._border(open_[-1][1])

    def _close(self, open_: list, tag: str) -> None:
        for k in range(len(open_) - 1, 0, -1) if self.opened[tag] else ():
            if open_[k][0] == tag:
                self._pop(open_, k)
                return
            if open_[k][0] in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                break
        if tag in ("p", "br"):
            self._border(open_[-1][1])

    def _start(self, open_: list, tag: str, attributes: str, source: str, at: int) -> int:
        if tag in ENDS_P and self.opened["p"]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == "p":
                    self._pop(open_, k)
                    break
                if open_[k][0] not in INLINE:
                    break
        if tag in CLOSES:
            closes, bars = CLOSES[tag]
            for k in range(len(open_) - 1, 0, -1) if any(self.opened[t] for t in closes) else ():
                if open_[k][0] in bars:
                    break
                if open_[k][0] in closes:
                    self._pop(open_, k)
                    if tag != "tr":
                        break
        node = open_[-1][1]
        if tag not in INLINE or tag == "br":
            self._border(node)
        if tag in VOID:
            if node >= 0:
                self.tags[node] += 1
            return at
        in_article = bool(self.opened["article"] or self.opened["main"])
        if node < 0 or tag in DROP or self.by_name and _around(tag, attributes, in_article):
            new = -1
        elif len(open_) > DEEPEST:
            new = node
            self.tags[node] += 1
        else:
            new = len(self.tag)
            self.tag.append(tag)
            self.parent.append(node)
            for counts in (self.tags, self.chars, self.link_tags, self.link_chars):
                counts.append(0)
        if tag in RAW:
            found = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            self._border(node)
            return found.end() if found else len(source)
        if attributes.endswith("/") and tag in ("svg", "path", "math"):
            return at
        open_.append((tag, new))
        self.opened[tag] += 1
        return at

    def _density(self, i: int, body: int) -> float:
        c, t, lc, lt = self.chars[i], max(self.tags[i], 1), self.link_chars[i], self.link_tags[i]
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + self.link_chars[body] / max(self.chars[body], 1) * c + math.e)
        return c / t * math.log(c / max(lc, 1) * t / max(lt, 1) + 1e-9) / math.log(base) if base > 1 + 1e-9 else c / t

    def article(self) -> int:
        """The node that holds the article."""
        body = self.tag.index("body") if "body" in self.tag else 0
        if not self.chars[body]:
            body = 0
        density = [self._density(i, body) for i in range(len(self.tag))]
        total = [0.0] * len(self.tag)
        for i in range(1, len(self.tag)):
            total[self.parent[i]] += density[i]
        inside = [False] * len(self.tag)
        for i in range(len(self.tag)):
            inside[i] = i == body or (i > 0 and inside[self.parent[i]])
        best = max((i for i in range(len(self.tag)) if inside[i]), key=lambda i: (total[i] if self.chars[i] else -1.0, -i), default=body)
        path = [best]
        while path[-1] != body and path[-1] > 0:
            path.append(self.parent[path[-1]])
        least = min(density[i] for i in path)
        chosen, children = best, {i: [] for i in path}
        for k in range(1, len(self.tag)):
            if self.parent[k] in children and self.chars[k]:
                children[self.parent[k]].append(k)
        for below, above in zip(path, path[1:], strict=False):
            if all(k == below or density[k] >= least or self.tag[k] in ("h1", "h2", "h3", "h4", "h5", "h6", "p") for k in children[above]):
                chosen = above
            else:
                break
        return chosen

    def text(self) -> str:
        top = self.article()
        inside = [False] * len(self.tag)
        inside[top] = True
        for i in range(top + 1, len(self.tag)):
            inside[i] = inside[self.parent[i]]
        blocks, now = [], []
        for node, piece in self.pieces:
            if not inside[node]:
                continue
            if piece:
                now.append(piece)
            elif now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        blocks.append(" ".join("".join(now).split()))
        return " ".join(b for b in blocks if b)


def main_text(source: str) -> str:
    """The article's text; names of classes are not believed if they leave nothing."""
    return (Page(source).text() or Page(source, by_name=False).text()) if source else ""


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        text = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page, from its whole html.

    Pages without html, and pages without article text, have an empty text; of
    nodes with the same sum the first is taken. Null ids and urls stay null.
    Repeated rows each give a row; an empty table gives an empty result. No shuffle.
    """
    take = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    out = take.mapInArrow(_extract, f"id {take.schema['id'].dataType.simpleString()}, url {take.schema['url'].dataType.simpleString()}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
