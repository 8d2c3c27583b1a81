"""Main-text extraction from HTML by tree scoring.

A page becomes a small element tree.  Elements that are never article text (menus, forms, adverts,
comments, ...) go with all they hold; readers' comments are also known by their structure.  Every remaining paragraph gives points for its length and
its commas to its ancestors, less with each level; an element's points are discounted by its link
density.  The best container is kept, and what stands beside it or the elements around it if paragraphs
with few links do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and attribute names of HTML, and words that page authors use in class and id names.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main",
         "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NEVER = {"head", "script", "style", "noscript", "template", "iframe", "noembed", "noframes", "object", "svg", "canvas", "audio", "video", "map",
         "nav", "menu", "header", "footer", "aside", "form", "search", "fieldset", "button", "select", "datalist", "textarea", "label", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
ASIDE_WORDS = {"ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promos",
               "promotion", "banner", "nav", "navbar", "navigation", "menu", "menus", "submenu", "breadcrumb", "breadcrumbs", "header", "masthead",
               "topbar", "footer", "foot", "copyright", "colophon", "sidebar", "sidebars", "aside", "rail", "widget", "widgets", "related",
               "recommended", "recommendations", "outbrain", "taboola", "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus",
               "discussion", "feedback", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "disclaimer", "popup",
               "modal", "overlay", "paywall", "newsletter", "subscribe", "subscription", "signup", "login", "register", "share", "sharing", "social",
               "toolbar", "pagination", "pager", "search", "searchbox", "form", "hidden", "toc", "skip",
               "kommentar", "kommentare", "werbung", "anzeige", "anzeigen", "commentaire", "commentaires", "publicite", "comentario", "comentarios",
               "publicidad", "navegacion"}
#: Of these words, those for what others wrote or sell: no text makes such an element the article, unless it is all the page has.
FOREIGN = {"ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "outbrain", "taboola",
           "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "cookie", "cookies", "consent", "gdpr",
           "kommentar", "kommentare", "werbung", "anzeige", "anzeigen", "commentaire", "commentaires", "publicite", "comentario", "comentarios", "publicidad"}
#: And those that stay out inside an article, however long; the other words may name a section of it.
BOXES = FOREIGN | {"newsletter", "subscribe", "subscription", "signup", "login", "paywall", "popup", "modal", "sidebar", "sidebars", "widget", "widgets",
                   "navbar", "breadcrumb", "breadcrumbs", "submenu", "share", "sharing", "social", "pagination", "pager", "hidden", "form"}
MAIN_NAMES = {"article", "content", "main", "post", "entry", "story", "page", "wrapper", "container", "body", "text"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<(?:/?[A-Za-z])[^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
COMMAS = re.compile("[,،、，]")
#: Headings of comment sections.
COMMENTS = re.compile(r"(?:\d+ |leave a |reader |leser|user )?(?:comments?|replies|reply|kommentare?|commentaires?|comentarios?)(?: ?\(\d+\))?:?", re.I)
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
#: Elements that are text of the article beside its paragraphs.
TEXT = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "p", "blockquote", "pre", "ul", "ol", "dl", "table", "figure"}
LEAST = 25  # code points of a paragraph that gives points


def aside_words(tag: str, attributes: str) -> set[str] | None:
    """None if an element is page furniture by its tag, role or state; else the words that say so by its
    names or as a form, which its text can overrule (none: no furniture)."""
    if tag in NEVER and tag not in ("form", "fieldset"):
        return None
    words_of = {"form"} if tag in ("form", "fieldset") else set()
    if not attributes or tag in ("html", "body"):
        return words_of
    values = {}
    for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
        values.setdefault((name or bare).lower(), unescape(a or b or c))
    role = values.get("role", "").lower()
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or role in ROLES and role != "form" or HIDDEN.search(values.get("style", "")):
        return None
    if role == "form":
        words_of.add("form")
    names = [*values.get("class", "").split(), *values.get("id", "").split()]
    if tag in ("article", "main") and not any(w.lower() in ("comment", "reply") for n in names for w in NAME_WORD.findall(n)):
        return words_of
    if any(n.lower() in MAIN_NAMES for n in names):
        return words_of
    for n in names:
        words = [w.lower() for w in NAME_WORD.findall(n)]
        words_of.update(w for before, w in zip(["", *words], words) if w in ASIDE_WORDS and before not in ("no", "has", "with", "without"))
    return words_of


class Tree:
    """Elements in page order (parent numbers, tags, flags of certain furniture) and the text blocks in them."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.out = [-1], ["#root"], [False]
        self.words: dict[int, set[str]] = {}  # elements that their names or a form tag make furniture
        self.blocks: list[tuple[int, str, int]] = []  # innermost block element, text, code points inside links
        open_, links, pieces, linked = [0], 0, [], []
        at, end = 0, len(html)

        def flush(tree=self) -> None:
            if pieces:
                text = " ".join(unescape("".join(pieces)).split())
                if text:
                    inside = len(" ".join(unescape("".join(linked)).split())) if linked else 0
                    holder = next(k for k in reversed(open_) if k == 0 or tree.tag[k] in BLOCK)
                    tree.blocks.append((holder, text, inside))
                pieces.clear(), linked.clear()

        def close(upto: int) -> None:
            nonlocal links
            links -= sum(self.tag[k] == "a" for k in open_[upto:])
            del open_[upto:]

        while at < end:
            m = TAG.search(html, at)
            text, at = (html[at:m.start()], m.end()) if m else (html[at:], end)
            if text and not self.out[open_[-1]]:
                pieces.append(text)
                if links:
                    linked.append(text)
            tag = m and (m[2] or m[5])
            if not tag:
                continue
            tag, attributes = tag.lower(), m[3] or m[6] or ""
            if tag in BLOCK and not self.out[open_[-1]]:
                flush()
            if m[1] or m[4]:
                for k in range(len(open_) - 1, 0, -1):
                    if self.tag[open_[k]] == tag:
                        close(k)
                        break
                    if tag == "p" and self.tag[open_[k]] in ("div", "article", "section", "td", "li"):
                        break
                continue
            if tag == "br" and not self.out[open_[-1]]:
                pieces.append(" ")
            if tag in VOID:
                continue
            if tag in BLOCK or tag in CLOSED_BY:  # end tags that may be left out
                shut = CLOSED_BY.get(tag, ()) if tag in CLOSED_BY else ("p",)
                for k in range(len(open_) - 1, 0, -1):
                    own = self.tag[open_[k]]
                    if own in shut or own == "p":
                        close(k)
                        break
                    if own in BLOCK and own not in ("p", "dd", "dt", "li") or own in ("ul", "ol", "dl", "table"):
                        break
            n = len(self.tag)
            self.parent.append(open_[-1])
            self.tag.append(tag)
            known_as = tag
            if tag in ("header", "label", "button"):  # an article's own header is text, so are labels and buttons that a sentence speaks of
                around = {self.tag[k] for k in open_}
                if "article" in around if tag == "header" else "p" in around and not around & {"form", "fieldset"}:
                    known_as = "div" if tag == "header" else "span"
            words = set() if self.out[open_[-1]] or tag in RAW else aside_words(known_as, attributes)
            self.out.append(self.out[open_[-1]] or tag in RAW or words is None or bool(words) and tag not in BLOCK)
            if words and tag in BLOCK:
                self.words[n] = words
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = stop.start() if stop else end
                open_.append(n)
                continue
            if attributes.endswith("/") and tag not in BLOCK:
                continue
            open_.append(n)
            links += tag == "a"
        flush()


def mark_comments(tree: Tree) -> None:
    """Name the elements that hold readers' comments by structure: article elements inside an article that says
    at least as much itself; what a heading like "3 comments" opens; and lists whose entries each hold
    a time and an author (a link, cite or address) if more text stands outside."""
    n, mark = len(tree.tag), lambda k: tree.words.setdefault(k, set()).add("comments")
    own = [0] * n  # text of paragraphs, by innermost block
    for holder, text, _ in tree.blocks:
        own[holder] += len(text) if len(text) >= LEAST else 0
    articles = [k for k in range(n) if tree.tag[k] == "article" and not tree.out[k]]
    if len(articles) > 1:
        outer = [-1] * n  # innermost article around or at the element
        for k in range(1, n):
            outer[k] = k if tree.tag[k] == "article" else outer[tree.parent[k]]
        said: dict[int, int] = {}
        for k in range(n):
            said[outer[k]] = said.get(outer[k], 0) + own[k]
        inner: dict[int, list[int]] = {}
        for k in articles:
            if outer[tree.parent[k]] >= 0:
                inner.setdefault(outer[tree.parent[k]], []).append(k)
        for k, nested in inner.items():
            if 0 < max(said[i] for i in nested) <= said[k]:
                for i in nested:
                    mark(i)
    children: dict[int, list[int]] = {}
    for k in range(1, n):
        children.setdefault(tree.parent[k], []).append(k)
    before = 0  # text of paragraphs in page order
    for holder, text, _ in tree.blocks:
        if tree.tag[holder] in HEADINGS and before and COMMENTS.fullmatch(text):
            up = tree.parent[holder]
            if children[up][0] == holder and tree.tag[up] not in ("article", "main", "body", "html", "#root"):
                mark(up)
                continue
            mark(holder)
            for k in children[up][children[up].index(holder) + 1:]:
                if HEADINGS.get(tree.tag[k], 9) <= HEADINGS[tree.tag[holder]]:
                    break
                mark(k)
        before += len(text) if len(text) >= LEAST else 0
    if "time" in tree.tag:
        dated, by, text = [t == "time" for t in tree.tag], [t in ("a", "cite", "address") for t in tree.tag], own[:]
        for k in range(n - 1, 0, -1):
            up = tree.parent[k]
            dated[up], by[up], text[up] = dated[up] or dated[k], by[up] or by[k], text[up] + text[k]
        for k, inside in children.items():
            entries = [i for i in inside if tree.tag[i] in BLOCK and dated[i] and by[i] and text[i]]
            if len(entries) > 1 and tree.tag[k] not in ("article", "main", "body", "html", "#root") and 2 * text[k] < text[0] and sum(text[i] for i in entries) >= 0.8 * text[k]:
                mark(k)


def furniture(tree: Tree) -> tuple[list[bool], list[int], list[int]]:
    """Which elements lie in furniture, and for each element the code points outside links and inside
    them of its paragraphs, without what foreign elements in it hold.

    An element that only its names or a form tag make furniture is none if it holds an article or main
    element with at least half the text of the longest, or, where none stands outside it, most of the
    page's paragraphs."""
    mark_comments(tree)
    n = len(tree.tag)
    foreign = [False] * n
    for k in range(1, n):
        foreign[k] = foreign[tree.parent[k]] or bool(FOREIGN & tree.words.get(k, set()))
    text, inner, every = [0] * n, [0] * n, [0] * n
    for holder, block, inside in tree.blocks:
        every[holder] += len(block)
        if len(block) >= LEAST and not foreign[holder]:
            text[holder] += len(block) - inside
            inner[holder] += inside
    for k in range(n - 1, 0, -1):
        for sums in (text, inner, every):
            sums[tree.parent[k]] += sums[k]
    marked = [k for k in range(n) if tree.tag[k] in ("article", "main") and every[k] and k not in tree.words and not foreign[k]]
    longest = max((every[k] for k in marked), default=0)
    heavy: dict[int, int] = {}  # longest marked element inside
    for k in marked:
        up = tree.parent[k]
        while up > 0:
            heavy[up] = max(heavy.get(up, 0), every[k])
            up = tree.parent[up]
    out = [False] * n
    for k in range(1, n):
        words = tree.words.get(k)
        out[k] = out[tree.parent[k]]
        if words and not out[k]:
            holds = 2 * heavy.get(k, 0) >= longest > 0
            most = not longest and (every[k] == every[0] if words & FOREIGN else 2 * text[k] > text[0] and text[k] > 3 * inner[k])
            out[k] = not (holds or most)
    return out, text, inner


def main_text(html: str) -> str:
    """The article of a page: its blocks in page order, white space inside a block made one space."""
    tree = Tree(html)
    n = len(tree.tag)
    out, paragraphs, inner = furniture(tree)
    points, size, linked, links = [0.0] * n, [0] * n, [0] * n, [0] * n
    for k in range(1, n):
        links[tree.parent[k]] += tree.tag[k] == "a" and not out[k]
    for holder, text, inside in tree.blocks:
        if out[holder]:
            continue
        worth = 1 + len(COMMAS.findall(text)) + min(len(text) // 100, 3) if len(text) >= LEAST else 0
        worth *= 1 - inside / len(text)
        # what holds the text directly is the paragraph; if it is a container itself it counts as one
        k, level = (holder if tree.tag[holder] in ("div", "section", "article", "main", "body", "td", "#root") else tree.parent[holder]), 0
        while k > 0 and worth:
            points[k] += worth / (1, 2, 6, 9, 12)[min(level, 4)]
            k, level = tree.parent[k], level + 1
        size[holder] += len(text)
        linked[holder] += inside
    for k in range(n - 1, 0, -1):  # children come after their parents
        size[tree.parent[k]] += size[k]
        linked[tree.parent[k]] += linked[k]
        links[tree.parent[k]] += links[k] if tree.tag[k] != "a" else 0
    final = [p * (1 - linked[k] / size[k]) if size[k] else 0.0 for k, p in enumerate(points)]
    menus = {k for k in range(1, n) if tree.tag[k] in ("ul", "ol", "div", "section", "table") and links[k] >= 3 and linked[k] >= 0.8 * size[k]}

    def above(k: int) -> Iterator[int]:
        while k >= 0:
            yield k
            k = tree.parent[k]

    best = max(range(n), key=lambda k: (final[k], -k))
    if not final[best]:  # only short texts: the marked article, or all that is left
        marked = [k for k in range(n) if tree.tag[k] in ("article", "main") and size[k]]
        best = max(marked, key=lambda k: (size[k], -k), default=0)
    best = next((k for k in above(best) if tree.tag[k] == "article"), None) or next((k for k in above(best) if tree.tag[k] == "main"), best)
    if tree.tag[best] not in ("body", "html", "#root"):  # a section of the article may have a name like furniture
        back = [False] * n
        for k in range(best + 1, n):
            up = tree.parent[k]
            inside = up == best or back[up]
            words = tree.words.get(k)
            back[k] = inside and (not words or not out[k] or not words & BOXES and paragraphs[k] > 80 and paragraphs[k] > 3 * inner[k])
            out[k] = out[k] and not back[k]
    inside = [False] * n
    for k in range(n):
        inside[k] = k == best or k > 0 and inside[tree.parent[k]]
    # a list of links that follows the article's text is a part of it (sources, papers), one before is a menu
    start = next((holder for holder, text, linked_ in tree.blocks if inside[holder] and not out[holder] and len(text) >= LEAST and 4 * linked_ < len(text)), n)
    menus -= {k for k in menus if tree.tag[k] in ("ul", "ol") and inside[k] and k > start}
    keep, climbed = {best}, set()
    children: dict[int, list[int]] = {}
    for k in range(1, n):
        if size[k] and not out[k]:
            children.setdefault(tree.parent[k], []).append(k)
    low = lambda k: linked[k] < 0.25 * size[k]
    at = best
    while at > 0 and tree.tag[at] not in ("article", "main", "body", "html"):
        up = tree.parent[at]
        beside = [k for k in children.get(up, ()) if k != at and k not in menus]
        # the article goes on beside its best part if paragraphs stand there
        on = any(low(k) and paragraphs[k] >= LEAST for k in beside)
        for k in beside:
            heading = at == best and tree.tag[k] in ("h1", "h2") and k < best
            if heading or at == best and final[k] >= max(2, 0.2 * final[best]) or on and low(k) and (tree.tag[k] in TEXT or paragraphs[k] >= LEAST):
                keep.add(k)
        if on:
            climbed.add(up)
        at = up
    kept = [False] * n
    for k in range(n):
        kept[k] = (k in keep or k > 0 and kept[tree.parent[k]]) and k not in menus and not out[k]
    return "\n".join(text for holder, text, inside in tree.blocks if kept[holder] or holder in climbed and len(text) >= LEAST and 4 * inside < len(text))


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out`` (main text, "" if there is none) and n_chars (its code points).

    Defined cases: null and empty html give ""; a page is read whole, whatever its length; unclosed
    or misnested elements end where HTML lets them end, or with their parent; repeated rows give
    repeated results; an empty table stays empty; existing columns ``out`` and n_chars are replaced,
    other columns pass through."""
    @F.pandas_udf("string")
    def extracted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in parts:
            yield pd.Series([main_text(h) if h else "" for h in html], dtype=object)

    return pages.withColumn(out, extracted(F.col(html_col))).withColumn("n_chars", F.length(out).cast("long"))
