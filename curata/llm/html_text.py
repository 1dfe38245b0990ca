"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and text.  Every text belongs to a block (what lies between two block-level tags) and
to the path of open block-level tags from the root.  Per root-to-leaf path the text length, the link text length and the
punctuation are summed; their ratios (text per tag, punctuation per character, share outside links) are smoothed over
neighbouring blocks in page order, fused by product, and the paths whose fused ratio reaches a share of the page's best
are content, and headings right before them.  Elements that never hold the article (scripts, styles, forms, navigation, notices, comments and so on) are
left out by tag, where they are hidden, or by the words of their class, id and role; these words do not drop an element that
holds the only ``article`` or ``main``, or most of the text of a page without one.  Where ``article`` or ``main`` elements hold most of the
fused weight, only they are searched, by the same ratios: a list of links within an article is left out.

Edge cases: null or empty html gives empty text; markup that is never closed ends with the page; character references
are decoded in texts only; repeated pages give repeated results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html as references
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from curata.llm.textmap import map_texts

# Comments, declarations, tags (quoted attribute values may hold >) and texts, in page order.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|([^<]+|<)""", re.S)
_RAW_END = {t: re.compile(rf"</{t}[\s/>]|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav header footer aside form button select menu dialog head noscript iframe svg canvas object video audio figure template".split())
_CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOILER = re.compile(r"(?<![a-z])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side-bar|aside|ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget|comments?|comment-?list|replies|respond|disqus|pagination|pager|toolbar|search\w*|form|copyright|skip\w*|hidden)(?![a-z])", re.I)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_STATE = re.compile(r"(?:has|with|without|no|is)[-_]", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*display\s*:\s*none|'[^']*display\s*:\s*none|[^\s"']*display:none))""", re.I)
_QUOTED = re.compile(r"""("[^"]*"|'[^']*')""")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Share of the best fused ratio that a path needs, and blocks on each side that smoothing takes in.
THRESHOLD, REACH = 0.02, 2


class _Block:
    __slots__ = ("text", "path", "link", "inside", "tag", "doubts")

    def __init__(self, text: str, path: int, link: int, inside: bool, tag: str, doubts: tuple[int, ...]) -> None:
        self.text, self.path, self.link, self.inside, self.tag, self.doubts = text, path, link, inside, tag, doubts


def _hidden(attributes: str) -> bool:
    """Whether an element is hidden by attribute or style; words within other quoted values do not count."""
    kept = [x if k % 2 == 0 or parts[k - 1].rstrip().lower().endswith(("style=", "aria-hidden=")) else '""' for parts in [_QUOTED.split(attributes)] for k, x in enumerate(parts)]
    return bool(_HIDDEN.search("".join(kept)))


def _boiler(attributes: str) -> bool:
    return any(_BOILER.search(x) and not _STATE.match(x) for value in _ATTRIBUTE.findall(attributes) for x in value.strip("\"'").split())


def blocks_of(page: str) -> list[_Block]:
    """The page's text blocks outside elements that never hold the article."""
    # Block-level: name, left out, inside article or main, doubtful elements, number of the path from the root.
    open_tags: list[tuple[str, bool, bool, tuple[int, ...], int]] = []
    numbers: dict[tuple[int, str], int] = {}  # a path by the path above and its last name, so deep nesting costs no more
    depth: dict[str, int] = {}  # open tags by name
    doubtful: list[list] = []  # elements of such words: characters, whether they hold article or main
    clear = False  # an article or main outside them
    parts: list[str] = []
    link_depth = linked = 0
    out: list[_Block] = []

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            parts.clear()
            if text:
                inside = bool(open_tags) and open_tags[-1][2]
                out.append(_Block(text, open_tags[-1][4] if open_tags else 0, min(linked, len(text)), inside, open_tags[-1][0] if open_tags else "", open_tags[-1][3] if open_tags else ()))
                for k in out[-1].doubts:
                    doubtful[k][0] += len(text)
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m[4]
        if text is not None:
            if not (open_tags and open_tags[-1][1]):
                parts.append(text)
                if link_depth:
                    linked += len(text)
            continue
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in _INLINE:
                link_depth -= name == "a" and link_depth > 0
                continue
            flush()
            while depth.get(name):  # an end without a beginning closes nothing
                closed = open_tags.pop()[0]
                depth[closed] -= 1
                if closed == name:
                    break
            link_depth = 0
            continue
        if name in _INLINE:
            if name == "br":
                parts.append(" ")
            link_depth += name == "a"
            continue
        flush()
        if name in _RAW_END:
            at = _RAW_END[name].search(page, at).start()
            close = page.find(">", at)
            at = end if close < 0 else close + 1
            continue
        if name in _VOID:
            continue
        if open_tags and open_tags[-1][0] in _CLOSES_ITSELF.get(name, {"p"}):
            depth[open_tags.pop()[0]] -= 1
        above = open_tags[-1] if open_tags else ("", False, False, (), 0)
        attributes = m[3]
        inside = above[2] or name in ("article", "main")
        boiler = above[1] or name in _NEVER and not (name in ("header", "figure") and above[2])
        doubts = above[3]
        if not boiler and attributes and name not in ("html", "body", "article", "main"):
            boiler = _hidden(attributes)
            if not boiler and _boiler(attributes):
                doubts = (*doubts, len(doubtful))
                doubtful.append([0, False])
        if name in ("article", "main") and not boiler:
            clear = clear or not doubts
            for k in doubts:
                doubtful[k][1] = True
        if attributes.endswith("/"):
            continue
        open_tags.append((name, boiler, inside, doubts, numbers.setdefault((above[4], name), len(numbers) + 1)))
        depth[name] = depth.get(name, 0) + 1
    flush()
    total = sum(len(b.text) for b in out)
    dropped = {k for k, (chars, holds) in enumerate(doubtful) if clear or not (holds or 2 * chars > total)}
    return [b for b in out if dropped.isdisjoint(b.doubts)]


def main_text(page: str) -> str:
    """The article's blocks, joined by an empty line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        s[0] += len(b.text)
        s[1] += b.link
        s[2] += len(_PUNCTUATION.findall(b.text))
        s[3] += 1
    # Ratios of each path: text per node, share outside links, punctuation per character.
    ratio = {p: (s[0] / s[3]) * max(0.0, 1.0 - s[1] / s[0]) * (0.2 + min(1.0, 25.0 * s[2] / s[0])) for p, s in sums.items()}
    smooth: dict[int, float] = {}
    weights = [ratio[b.path] for b in blocks]
    for k, b in enumerate(blocks):
        near = weights[max(0, k - REACH) : k + REACH + 1]
        fused = (weights[k] * (sum(near) / len(near))) ** 0.5
        smooth[b.path] = max(smooth.get(b.path, 0.0), fused)
    mass = {True: 0.0, False: 0.0}
    for b in blocks:
        mass[b.inside] += smooth[b.path] * len(b.text)
    only = mass[True] > mass[False]
    if only:
        blocks = [b for b in blocks if b.inside]
    least = THRESHOLD * max(smooth[b.path] for b in blocks)
    # A heading goes with the text that follows it, whatever its own ratio.
    kept, after = [], False
    for b in reversed(blocks):
        good = smooth[b.path] >= least
        if b.tag in _HEADING:
            good = good or after
        else:
            after = good
        if good:
            kept.append(b.text)
    return "\n\n".join(kept[::-1])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id, url, text, n_chars (code points of the text)."""

    def make():
        def work(htmls: list[str]) -> list:
            texts = [main_text(h) for h in htmls]
            return [texts, [len(t) for t in texts]]

        return work

    return map_texts(pages, html_col, [id_col, url_col], [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make)
