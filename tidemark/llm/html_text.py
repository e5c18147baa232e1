"""Main text of web pages: the maximum-scoring subsequence of a page's words and tags.

Words score by the elements around them, the nearest most, tags cost; the weights are log odds of main and other text
that are counted on labelled pages. One linear scan finds the contiguous stretch of the page with the largest sum; blocks
inside it that score below zero themselves (adverts, comments, notices within the article) are left out. An element that
holds nearly all of a page, such as a form round everything or a body of class has-sidebar, tells nothing about its text:
where the scan leaves most of a page out, such elements lose their weight and it runs again.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: Elements whose content is no text of the page, whose tags end a block, that have no end tag.
SILENT = frozenset("script style template noscript svg math iframe object canvas audio video head title select option textarea button datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that ends an open element of the second kind.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
CLOSES.update({t: {"p"} for t in BLOCK - set(CLOSES) - {"html"}})
#: An element beyond which an implied end does not reach.
FENCE = frozenset("table ul ol dl section article aside nav header footer main form div blockquote body".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>?|<[a-zA-Z/][^<>]*>?|[^<]+|<", re.S)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")}
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
#: Attributes that count; start tags that do not end an open head.
NAMES = frozenset("class id role data-main hidden aria-hidden itemprop".split())
IN_HEAD = frozenset("html head title meta link base style script noscript template".split())
PART = re.compile(r"[a-z]+")
#: What an element's weight is worth outside another one that tells something, and from which weight on one does.
OUTER, TELLING = 0.3, 0.5
#: Elements begin to lose weight with `FADING` of a page's unlinked words inside, and have none with `WHOLE`: those around
#: what was found, where that is less than half of the page, and all where it is less than `LITTLE`.
LITTLE, FADING, WHOLE = 0.05, 0.5, 0.8

#: Labelled pages: elements with data-main hold main text; {n} stands for n words.
LABELLED = (
    '<header class="site-header"><div class="logo">{3}</div><p>{5}</p></header><nav class="menu main-menu"><ul><li><a>{2}</a></li><li><a>{2}</a></li><li><a>{1}</a></li></ul></nav><main><article data-main><h1>{8}</h1><p>{60}</p><h2>{5}</h2><p>{80}</p><ul><li>{12}</li><li>{9}</li></ul><p>{70}</p></article></main><aside class="sidebar"><h3>{2}</h3><ul><li><a>{5}</a></li><li><a>{6}</a></li></ul></aside><footer class="site-footer"><p>{14}</p><a>{2}</a></footer>',
    '<div id="cookie" class="cookie-notice banner"><p>{20}</p><button>{1}</button></div><div id="nav"><a>{1}</a><a>{2}</a></div><div id="content" class="content" data-main><h1>{7}</h1><div>{50}</div><p>{90}</p><blockquote>{30}</blockquote><p>{40}</p></div><div id="comments" class="comments"><h3>{2}</h3><div class="comment"><p>{25}</p></div><div class="comment reply"><p>{30}</p></div></div><div id="footer">{12}</div>',
    '<body><div class="ad advert">{12}</div><article><h1 data-main>{8}</h1><p data-main>{70}</p><div class="ad ads advertisement sponsored promo">{15}</div><p data-main>{60}</p><table data-main><tr><td>{4}</td><td>{3}</td></tr></table><div class="share social"><a>{1}</a><a>{1}</a></div><section class="comments discussion responses"><p>{40}</p><p>{25}</p></section><aside class="related recommended"><a>{7}</a><a>{8}</a></aside></article><form class="newsletter signup subscribe"><p>{10}</p><label>{2}</label></form></body>',
    '<div class="header"><div>{4}</div></div><div class="breadcrumb breadcrumbs"><a>{1}</a><a>{2}</a></div><div class="post entry story" data-main><p>{50}</p><p>{50}</p><pre>{20}</pre><figure><figcaption>{9}</figcaption></figure></div><div class="widget sidebar"><p>{12}</p></div><div class="footer copyright legal"><p>{16}</p></div><form><label>{2}</label><p>{6}</p><input></form>',
    '<nav role="navigation"><a>{2}</a><a>{2}</a></nav><div role="main" data-main><p>{80}</p><ol><li>{15}</li><li>{14}</li></ol></div><div class="notice alert popup modal overlay consent gdpr"><p>{22}</p></div><div class="tags meta"><a>{1}</a></div><div role="contentinfo"><p>{12}</p></div><div role="complementary"><p>{18}</p></div><div role="banner"><p>{6}</p></div><div role="search"><p>{3}</p></div>',
    '<table><tr><td class="toolbar menu"><a>{2}</a><a>{1}</a></td><td class="text" data-main><p>{60}</p><p>{55}</p></td></tr></table><section data-main><h2>{4}</h2><p>{45}</p><dl><dt>{2}</dt><dd>{14}</dd></dl></section><ul class="pagination pager"><li><a>{1}</a></li></ul><div class="disqus thread feedback reviews"><p>{35}</p></div><div class="subscribe"><p>{9}</p></div><div class="teaser trending popular"><a>{6}</a><a>{7}</a></div>',
    '<body class="single page-template has-sidebar no-js"><div id="page" class="site wrapper"><div class="site-header"><p>{6}</p></div><div class="site-content container"><div id="primary" class="content-area" data-main><h1>{7}</h1><p>{70}</p><p>{80}</p></div><div class="sidebar widget"><p>{15}</p></div></div><div class="site-footer"><p>{14}</p></div></div></body>',
)


class Block:
    """Text between tags that end one: its words, the innermost element (by the number of its start tag) for each token
    around it, the tags before it, whether it is marked as main."""

    __slots__ = ("inside", "main", "tags", "text", "words")

    def __init__(self, text: str, words: int, inside: dict[str, int], tags: int, main: bool):
        self.text, self.words, self.inside, self.tags, self.main = text, words, inside, tags, main

    @property
    def tokens(self) -> frozenset:
        return frozenset(self.inside)

    @property
    def linked(self) -> bool:
        return "a" in self.inside


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, each with the tokens of the elements around it and the tags since the last.

    A token is an element's name or a name in its class, id or role, whole and by its parts (site-header, site, header).
    Text in a link is a block's part that counts as linked: a block whose words are mostly in links has the token 'a'.
    """
    out: list[Block] = []
    stack: list[tuple[str, list, bool, bool]] = []  # name, tokens, silent, main
    names, marks, flags = defaultdict(int), defaultdict(list), [0, 0]  # open elements by name, their numbers by token, silent and main ones
    parts: list[str] = []
    linked = tags = number = 0
    at, end = 0, len(page)

    def cut(k):
        """Ends the element at place k of the stack and those inside it."""
        while len(stack) > k:
            name, tokens, silent, main = stack.pop()
            names[name] -= 1
            for t in tokens:
                marks[t].pop()
                if not marks[t]:
                    del marks[t]
            flags[0] -= silent
            flags[1] -= main

    def flush():
        nonlocal linked, tags
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            n = text.count(" ") + 1
            inside = {t: open_[-1] for t, open_ in marks.items() if t != "a"}
            if 2 * linked > n:
                inside["a"] = number + 1
            out.append(Block(text, n, inside, tags, flags[1] > 0))
            tags = 0
        linked = 0

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            raw = m[0]
            if raw[0] == "<" and len(raw) > 1:
                continue
            if stack and stack[-1][0] == "head" and not raw.isspace():
                cut(len(stack) - 1)
            if not flags[0]:
                text = html.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if names["a"]:
                    linked += len(text.split())
            continue
        name = name.lower()
        tags += 1
        if m[1]:
            for k in range(len(stack) - 1, -1, -1) if names[name] else ():
                if stack[k][0] == name:
                    if name in BLOCK or any(e[0] in BLOCK for e in stack[k:]):
                        flush()
                    cut(k)
                    break
                if stack[k][0] in FENCE and name not in BLOCK:
                    break
            continue
        if names["head"] and name not in IN_HEAD:
            cut(next(k for k, e in enumerate(stack) if e[0] == "head"))
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            ends = CLOSES.get(name)
            if ends and any(names[e] for e in ends):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        cut(k)
                        break
                    if stack[k][0] in FENCE or stack[k][0] in ("td", "th", "li") and name not in CLOSES[stack[k][0]] and name not in ("li", "td", "th", "tr"):
                        break
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        tokens, silent, main = [name], name in SILENT, False
        for a in ATTRIBUTE.finditer(m[3]) if m[3] else ():
            key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
            if key not in NAMES:
                continue
            if key == "data-main":
                main = True
            elif key == "hidden" or key == "aria-hidden":
                silent |= key == "hidden" and value != "until-found"
            else:
                for whole in value.split():
                    parts_of = PART.findall(whole)
                    tokens += parts_of if len(parts_of) == 1 else [whole, *parts_of]
        if name in RAW_END:
            stop = RAW_END[name].search(page, at)
            at = stop.start() if stop else end
            continue
        stack.append((name, tokens, silent, main))
        names[name] += 1
        number += 1
        for t in tokens:
            marks[t].append(number)
        flags[0] += silent
        flags[1] += main
    flush()
    return out


class RegionModel:
    """Log odds: of a word with no known token, of each token, and of a tag."""

    def __init__(self, base: float, weights: dict[str, float], tag: float):
        self.base, self.weights, self.tag = base, weights, tag

    def score(self, block: Block, worth: dict[int, float] | None = None) -> float:
        """Score of each word of a block: up to 2, and not below -0.2, so that an advert doesn't cut an article in two.

        Elements count from the inside outwards, those outside one that tells something only a part. `worth` is the
        share of its weight that an element has kept.
        """
        at = defaultdict(float)
        for t, element in block.inside.items():
            w = self.weights.get(t)
            if w:
                at[element] += w
        total, share = self.base, 1.0
        for element in sorted(at, reverse=True):
            told = at[element] * worth.get(element, 1.0) if worth else at[element]
            total += share * told
            if abs(told) >= TELLING:
                share *= OUTER
        return max(-0.2, min(2.0, total))

    def region(self, blocks: list[Block], worth: dict[int, float] | None = None) -> list[Block]:
        """The blocks of the best stretch that score above zero."""
        each = [self.score(b, worth) for b in blocks]
        start, end = best_region([s * b.words + self.tag * b.tags for s, b in zip(each, blocks, strict=True)])
        return [b for b, s in zip(blocks[start:end], each[start:end], strict=True) if s > 0]


def kept_worth(blocks: list[Block]) -> dict[int, float]:
    """What share of its weight every element keeps by how much of the page's unlinked text it is around."""
    around, total = defaultdict(int), sum(b.words for b in blocks if not b.linked)
    for b in blocks:
        if not b.linked:
            for element in set(b.inside.values()):
                around[element] += b.words
    return {e: max(0.0, min(1.0, (WHOLE - n / total) / (WHOLE - FADING))) for e, n in around.items()}


def learn(pages) -> RegionModel:
    """Weights from labelled pages, whose main elements are marked with data-main.

    A token's weight is the log of its rate among the main words over that among the others (one word added to each),
    times the square of how far the rates differ of their sum, so that elements of both kinds hardly count; a word's
    base is half the log odds of words overall; a tag costs a small part of the log odds of tags a word. An element that
    holds text of both kinds (a tenth of either or more) is around the matter and no evidence for its tokens.
    """
    inside, outside = defaultdict(float), defaultdict(float)
    words, tags = [1.0, 1.0], [1.0, 1.0]
    for page in pages:
        blocks, held = blocks_of(page), defaultdict(lambda: [0, 0])
        for b in blocks:
            words[b.main] += b.words
            tags[b.main] += b.tags
            for element in set(b.inside.values()):
                held[element][b.main] += b.words
        for b in blocks:
            for t, element in b.inside.items():
                if 10 * min(held[element]) < sum(held[element]):
                    (inside if b.main else outside)[t] += b.words
    weights = {}
    for t in {*inside, *outside}:
        p, q = (inside[t] + 1) / words[1], (outside[t] + 1) / words[0]
        weights[t] = max(-6.0, min(3.0, math.log(p / q) * ((p - q) / (p + q)) ** 2))
    return RegionModel(0.5 * math.log(words[1] / words[0]), weights, -min(0.1, abs(math.log((tags[1] / words[1]) / (tags[0] / words[0]))) / 16))


@functools.cache
def built_in_model() -> RegionModel:
    return learn([re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), p) for p in LABELLED])


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch with the largest sum, the first of several; (0, 0) if none is above 0."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, found = total, (start, k + 1)
    return found


def main_text(page: str | None, model: RegionModel | None = None) -> str:
    """The main text of a page: its blocks joined by line breaks; empty for null or if all text is in links."""
    if not page:
        return ""
    model = model or built_in_model()
    blocks = blocks_of(page)
    found, free = model.region(blocks), sum(b.words for b in blocks if not b.linked)
    seen = sum(b.words for b in found)
    if 2 * seen < free:
        worth = kept_worth(blocks)
        if seen >= LITTLE * free:
            around = {e for b in found for e in b.inside.values()}
            worth = {e: x for e, x in worth.items() if e in around}
        found = model.region(blocks, worth) or found
    return "\n".join(b.text for b in (found or [b for b in blocks if not b.linked]))


def extract(pages: DataFrame, *, html_column: str = "html", out: str = "text", labelled: list[str] | None = None) -> DataFrame:
    """All columns and `out`, the main text of each page, from the whole page.

    `labelled` pages, where given, replace the built-in ones. Null and empty pages give an empty text; repeated rows
    stay; a column that is already named `out` is replaced; an empty table gives an empty result.
    """
    model = learn(labelled) if labelled else built_in_model()
    kept = [f for f in pages.schema.fields if f.name.lower() != out.lower()]

    def run(batches):
        for piece in slices(batches, html_column):
            names = piece.schema.names
            texts = [main_text(x, model) for x in piece.column(names.index(html_column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], [*names, out])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pages.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, f"{columns}, `{out}` string")
