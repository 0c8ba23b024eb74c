"""Main text of web pages by tree scoring.

A page becomes a tree of elements and of text runs (the text between two block
boundaries). Each run passes points for its length and commas to the elements
above it, less with each level; an element's points are discounted by its link
density; the best one and its siblings that look like content are kept. An article or
main element around it takes its place if the points of all its text, with a bonus for
the tag, come to as many after the discount.

Edge cases: null or empty html gives the empty text; a page without long
paragraphs falls back to its article, main or body element; unclosed, crossed
and stray tags are repaired as far as the nesting of blocks allows; very long pages
are read whole; repeated rows each get their row; a kept column named text or n_chars
is replaced by the result, other columns are ignored; an empty table gives an empty
result.

The names of furniture and of likely content follow the heuristics that public reader
views use (Readability, Apache-2.0), in a list of our own.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialseg.llm.columns import declared, fresh, without

#: Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "input", "button", "select", "option", "textarea"}
DROPPED = {"script", "style", "noscript", "template", "nav", "footer", "aside", "form", "fieldset", "button", "select", "textarea", "iframe", "svg", "math", "object", "embed", "applet", "canvas", "audio", "video", "head", "title", "menu", "dialog", "noembed", "noframes", "xmp", "link", "meta"}
#: What an end tag or a new element of the same family closes, and the elements that hold it in.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
BASE_SCORE = {"article": 10, "main": 8, "div": 5, "section": 4, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5}
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|h-entry|main|page|post|text|blog|story)(?=$|[\s_-])", re.I)
#: What a page's furniture is called, inside an article too, and the words that such names are made up with.
FURNITURE = set("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promotion promotions replies reply respond search shoutbox sidebar signup sponsor sponsored subscribe toolbar".split())
#: Furniture where no article or main element is open; inside one these name parts of the text.
AROUND = FURNITURE | set("agegate masthead outbrain overlay pager related rss share sharing skyscraper social taboola topbar widget".split())
HELPERS = set("area article articles bar block body bottom box button buttons container content entries global group icon icons inner item items left link links list main mobile module outer page panel pane post posts primary reader right secondary section site slot stories sub text thread top unit user widget wrap wrapper".split())
#: A slash that closes a tag, not the end of a value without quotes.
CLOSED = re.compile(r"(?:^|[\s\"'])/$|(?:^|\s)[^\s=\"'/]+/$")
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: For the rest of a page after a tag whose quotes do not end.
PLAIN_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RUN_MIN, LEVELS = 25, 6
#: Points of an article or main element for its tag. Of unnamed blocks that are mostly links, those with more links than this, before the first or after the last paragraph, are menus.
TAG_BONUS, MENU_LINKS = 25, 3


class Page:
    """Elements (parents, names, classes, links) and text runs in page order."""

    def __init__(self, source: str):
        self.parent, self.name, self.hint, self.drop, self.block = [-1], ["#root"], [""], [False], [0]
        self.runs: list[tuple[int, str, int]] = []  # (element, text, characters inside links)
        self.stack, self.open, self.blocks = [0], {"#root": [0]}, [0]  # the open elements, places of each name in the stack, places of blocks
        self.pieces: list[str] = []
        self.linked = 0
        self.read(source)

    def read(self, s: str) -> None:
        at, tags, last = 0, TAG, s.rfind(">")
        seen = 0
        while (p := s.find("<", seen)) >= 0 and (p <= last or s.startswith("<!--", p)):
            m = tags.match(s, p)
            if m is None:
                if s[p + 1 : p + 2].isalpha() or s[p + 1 : p + 2] == "/" and s[p + 2 : p + 3].isalpha():
                    tags = PLAIN_TAG
                    m = tags.match(s, p)
                if m is None:
                    seen = p + 1
                    continue
            if p > at:
                self.text(s[at:p])
            at = seen = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self.end(name)
                continue
            self.start(name, m[3])
            if name in RAW and not CLOSED.search(m[3]):
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(s, at)
                at = seen = close.end() if close else len(s)
                self.end(name)
        self.text(s[at:])
        self.flush()

    def text(self, t: str) -> None:
        if t and not self.drop[self.stack[-1]]:
            self.pieces.append(t)
            if "a" in self.open:
                self.linked += len("".join(t.split()))

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(htmllib.unescape("".join(self.pieces)).split())
            if text:
                self.runs.append((self.block[self.stack[-1]], text, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def pop(self) -> None:
        name = self.name[self.stack.pop()]
        self.open[name].pop()
        if not self.open[name]:
            del self.open[name]
        if self.blocks[-1] == len(self.stack):
            self.blocks.pop()

    def start(self, name: str, rest: str) -> None:
        if name == "br":
            if not self.drop[self.stack[-1]]:
                self.pieces.append(" ")
            return
        if name == "html" and "html" in self.open or name == "body" and "body" in self.open:
            return
        block = name not in INLINE
        if block:
            self.flush()
            closes, inside = SIBLINGS.get(name, (set(), set()))
            closes = closes | {"p"}
            while any(c in self.open for c in closes):
                at = self.block[self.stack[-1]]  # the innermost block; inline elements in it end with it
                if self.name[at] not in closes or self.name[at] in inside:
                    break
                while self.stack[-1] != at:
                    self.pop()
                self.pop()
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTR.findall(rest)} if rest else {}
        hint = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        top = self.stack[-1]
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        inside = "article" in self.open or "main" in self.open or name in ("h1", "h2", "h3", "h4", "h5", "h6")
        named = FURNITURE if inside else AROUND
        unlikely = name not in ("html", "body", "main") and any(furniture(x, named) for x in (*attrs.get("class", "").split(), attrs.get("id", "").strip()))
        header = name == "header" and "article" not in self.open and "main" not in self.open
        drop = self.drop[top] or name in DROPPED or header or hidden or unlikely or attrs.get("role", "").lower() in ROLES
        if name in VOID or name not in RAW and name in INLINE and CLOSED.search(rest):
            return
        self.parent.append(top)
        self.name.append(name)
        self.hint.append(hint)
        self.drop.append(drop)
        self.block.append(len(self.name) - 1 if block else self.block[top])
        if drop and not self.drop[top]:
            self.pieces and self.pieces.append(" ")
        if block:
            self.blocks.append(len(self.stack))
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(len(self.name) - 1)

    def end(self, name: str) -> None:
        if name not in self.open:
            if name in ("br", "p"):
                self.flush()
            return
        if name not in INLINE:
            self.flush()
        elif self.open[name][-1] < self.blocks[-1]:  # an inline end tag does not close blocks
            return
        while self.name[self.stack[-1]] != name:
            self.pop()
        self.pop()


def furniture(label: str, named: set[str] = FURNITURE) -> bool:
    """Whether a class or id names menus, headers, footers, sidebars, notices, adverts, forms or comments, by all of its words."""
    words = [w for w in re.split(r"[-_0-9]+", label.lower()) if w]
    return any(w in named for w in words) and all(w in named or w in HELPERS for w in words)


def main_text(source: str | None) -> str:
    """The kept blocks of a page, joined by one space."""
    if not source:
        return ""
    page = Page(source)
    parent, name = page.parent, page.name
    n = len(name)
    score, chars, links, points_in, anchors = [0.0] * n, [0] * n, [0] * n, [0.0] * n, [0] * n
    scored: set[int] = set()
    long_at: list[int] = []  # places of the runs that give points
    for place, (at, text, linked) in enumerate(page.runs):
        size = len(text) - text.count(" ")  # as characters inside links are counted
        share = min(1.0, linked / size)
        chars[at] += size
        links[at] += linked
        if len(text) < RUN_MIN or name[at] in ("h1", "h2", "h3", "h4", "h5", "h6", "#root", "html"):
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3)
        points *= 1 - share
        points_in[at] += points
        if share < 0.5:
            long_at.append(place)
        up, level = (parent[at], 0) if name[at] in ("p", "pre", "li", "td", "blockquote") else (at, 0)
        while up > 0 and level < LEVELS:
            score[up] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored.add(up)
            up, level = parent[up], level + 1
    for i in range(n - 1, 0, -1):  # children come after their parents
        chars[parent[i]] += chars[i]
        links[parent[i]] += links[i]
        points_in[parent[i]] += points_in[i]
        anchors[parent[i]] += anchors[i] + (name[i] == "a")
    density = lambda i: links[i] / chars[i] if chars[i] else 0.0
    weight = lambda i: BASE_SCORE.get(name[i], 0) + (25 if page.hint[i] and LIKELY.search(page.hint[i]) else 0)
    final = {}
    for i in scored:
        final[i] = (score[i] + weight(i)) * (1 - density(i))
    keep: set[int] = set()
    body = {i for i in scored if name[i] not in ("html", "#root")}
    if best := max(body, key=lambda i: (final[i], -i), default=0):
        up, most = best, final[best]
        while up > 0:
            if name[up] in ("article", "main") and (points_in[up] + weight(up) + TAG_BONUS) * (1 - density(up)) >= most:
                best = up
                break
            up = parent[up]
        keep.add(best)
        if name[best] not in ("article", "main", "body"):
            own = lambda i: score[i] * (1 - density(i))  # noqa: E731  points of the text alone
            bar = 0.2 * own(best)
            for i in range(1, n):
                if i == best or parent[i] != parent[best]:
                    continue
                alike = i in scored and name[i] == name[best] and density(i) < 0.25 and (page.hint[i] == page.hint[best] != "" or name[i] == "section")
                if alike or i in scored and own(i) >= bar or name[i] in ("p", "h1", "h2", "h3", "pre", "blockquote") and chars[i] and density(i) < 0.25:
                    keep.add(i)
        elif name[best] == "article":  # an article may come in several parts
            keep |= {i for i in body if name[i] == "article" and parent[i] == parent[best] and final[i] >= max(10.0, 0.2 * final.get(best, 0.0))}
    else:
        for tag in ("article", "main", "body", "#root"):
            if found := [i for i in range(n) if name[i] == tag and chars[i]]:
                keep.update(found[:1])
                break
    inside = [False] * n
    for i in range(n):
        inside[i] = i in keep or i > 0 and inside[parent[i]]
    if not any(name[i] in ("article", "main") for i in keep):  # inside these, lists of links are part of the text
        bare = any(name[i] in ("body", "#root") for i in keep)
        of_keep = [k for k in long_at if inside[page.runs[k][0]]]
        first, last = (of_keep[0], of_keep[-1]) if of_keep else (0, -1)
        starts, ends = [len(page.runs)] * n, [-1] * n  # the places of a block's first and last run
        for place, (at, _, _) in enumerate(page.runs):
            starts[at], ends[at] = min(starts[at], place), place
        for i in range(n - 1, 0, -1):
            starts[parent[i]], ends[parent[i]] = min(starts[parent[i]], starts[i]), max(ends[parent[i]], ends[i])
        for i in range(n):
            if i in keep or not inside[i]:
                continue
            edge = bare or ends[i] < first or starts[i] > last
            menu = edge and anchors[i] > MENU_LINKS and density(i) > 0.5 and name[i] in ("ul", "ol", "table", "div", "section")
            inside[i] = inside[parent[i]] and not menu or parent[i] < 0
    return " ".join(text for at, text, _ in page.runs if inside[at])


def extract_main_text(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` columns, text and n_chars (code points), one row per row of ``pages``."""

    keep = without(keep, ("text", "n_chars"))
    source = fresh("source", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(s.as_py()) for s in b.column(source)]
            yield pa.record_batch([*(b.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html_col).alias(source)).mapInArrow(run, f"{declared(pages, keep)}text string, n_chars long")
