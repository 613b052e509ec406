"""Main text of web pages by equivalence-class template deduction.

Pages of one host are dealt into groups of bounded size.  Within a group every token (a tag
with its path, or a block of text) has an *occurrence vector*: how often it stands on each page.
Tokens with equal vectors form an equivalence class; a class is *valid* when its tokens come in
one order on every page and the spans of its occurrences do not cross those of the classes
around it.  Valid classes nest into a template whose gaps are slots.  Slots inside the page's
article (or, without one, all slots whose texts vary over the pages) are extracted; slots and tokens under
menus, headers, footers, sidebars, notices, adverts, forms and comments are not.  Inside an article
the classes decide as well: blocks of a class that many articles of the group share are template,
but headings are the article's own wording.

A page that no template fits (too few pages of its host, or other tags) is cut up by its own
tags in the same way.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import parallelism, table

#: Pages of a group at most, about; fewest pages that a template is deduced from.
GROUP = 48
SUPPORT = 3

#: Elements without content, with raw content, and those that end a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math select object".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption head".split()
)
#: An opening tag ends these open elements first.
CLOSES = {
    **dict.fromkeys(
        "p div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 blockquote pre figure hr address fieldset details".split(),
        frozenset({"p"}),
    ),
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}),
}
#: An implied end does not reach beyond these.
FENCES = frozenset("html body article aside section div main nav header footer form table ul ol dl blockquote figure td th".split())
#: Elements, roles and words of class or id that mark what is not the article.
SIDE_TAGS = frozenset("nav aside footer form menu dialog button search".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adslot sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead "
    "topbar footer sidebar aside widget cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations comment comments commentlist respond replies disqus pagination pager toolbar skip".split()
)
HEADER_WORDS = frozenset({"header", "masthead"})
#: Words that mark a side part alone or beside such companions; in other compounds (``ad-hoc``, ``social-science``)
#: they are words of the page's subject.
LOOSE_WORDS = frozenset({"ad", "social"})
COMPANIONS = frozenset(
    "all area article articles bar block body bottom box break btn button buttons card center col column container content desktop entry feed footer form global group "
    "head heading holder icon icons inner item items js label left link links list main media message mobile module msg network networks news outer page panel placement post posts "
    "primary region right row secondary section site slot space spot stories story strip tag text title tools top unit user users wrap wrapper zone".split()
)
KEEP_TAGS = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Token(NamedTuple):
    """A tag or a block of text on a page, in page order."""

    kind: str  # "<", ">" or "t"
    path: tuple[str, ...]
    text: str
    article: int  # number of the article or main element around it, 0 outside
    side: bool  # under something that is not the article


#: How sure it is that an element is beside the article: only by a word of header, by a word among
#: others or as a form, by its whole class or id, or by what it is.
HEADER, WORD, NAMED, SURE = 1, 2, 3, 4


@lru_cache(maxsize=4096)
def _side(name: str, attrs: str) -> tuple[int, bool, str]:
    """How sure it is that an element is beside the article, whether it is a main element by role, and its label in paths."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    label = name + "".join("." + c for c in sorted(found.get("class", "").lower().split())[:3])
    role = found.get("role", "").lower()
    if name in KEEP_TAGS:
        words = {w.lower() for w in _WORDS.findall(found.get("class", "") + " " + found.get("id", ""))}
        beside = name == "article" and bool(words & {"comment", "comments", "related", "ad", "promo", "sponsored", "teaser"})
        return SURE if beside else 0, role == "main", label
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    names = [{w.lower() for w in _WORDS.findall(n)} for n in (found.get("class", "") + " " + found.get("id", "")).split()]
    names = [n for n in names if not (n & SIDE_WORDS <= LOOSE_WORDS and any(not w.isdigit() for w in n - SIDE_WORDS - COMPANIONS))]
    words = SIDE_WORDS & set().union(*names)
    if hidden or (name in SIDE_TAGS and name != "form") or (role in SIDE_ROLES and role != "form"):
        sure = SURE
    elif any(n and n <= SIDE_WORDS and not n <= HEADER_WORDS for n in names):
        sure = NAMED
    elif name == "form" or role == "form" or words - HEADER_WORDS:
        sure = WORD
    else:
        sure = HEADER if words else 0
    return sure, role == "main", label


def tokens(html: str) -> list[Token]:
    """The tags and text blocks of a page; white space in a block is one blank, references are decoded."""
    out: list[tuple] = []
    names: list[str] = []  # open elements
    labels: list[str] = []
    # at each depth: article number, whether it is surely beside the article, and the doubtful elements around it
    marks: list[tuple[int, bool, tuple[int, ...]]] = [(0, False, ())]
    doubts: list[tuple[int, int]] = []  # how sure, article number around
    holds: dict[int, set[int]] = defaultdict(set)  # articles in doubtful elements
    buffer: list[str] = []
    articles = 0
    at = 0
    page = html or ""

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append(("t", tuple(labels), text, *marks[-1]))

    def close(depth: int) -> None:
        while len(names) > depth:
            if names[-1] in BLOCKS:
                flush()
                out.append((">", tuple(labels), "", *marks[-1]))
            names.pop()
            labels.pop()
            marks.pop()

    last = page.rfind(">") + 1  # no tag ends beyond it
    while m := _TOKEN.search(page, at, last):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            buffer.append(m["cdata"].replace("&", "&amp;"))
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name in names:
                depth = len(names) - 1 - names[::-1].index(name)
                close(depth)
            elif name in BLOCKS:
                flush()
            continue
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        if name in RAW:
            flush()
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                stop = page.find(">", end.start()) if end else -1
                at = stop + 1 if stop >= 0 else len(page)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                buffer.append(" ")
            continue
        if name in CLOSES:
            for depth in range(len(names) - 1, -1, -1):
                if names[depth] in CLOSES[name]:
                    close(depth)
                    break
                if names[depth] in FENCES:
                    break
        if name in BLOCKS:
            flush()
        if attrs.rstrip().endswith("/") and name not in BLOCKS:
            continue
        article, side, around = marks[-1]
        sure, main, label = _side(name, attrs)
        if name == "header" and not article:
            sure = max(sure, NAMED)
        elif sure == HEADER:  # an article's own header holds its title
            sure = 0 if article else NAMED
        if main and sure < SURE:
            sure = 0
        side |= sure == SURE
        if 0 < sure < SURE:
            around = (*around, len(doubts))
            doubts.append((sure, article))
        elif name in ("article", "main") or main:
            if not side and (not article or name == "article"):
                articles += 1
                article = articles
                for d in around:
                    holds[d].add(article)
        names.append(name)
        labels.append(label)
        marks.append((article, side, around))
        if name in BLOCKS:
            out.append(("<", tuple(labels), "", *marks[-1]))
    if at < len(page):
        buffer.append(re.sub(r"<[^>]*\Z", "", page[at:]))
    flush()
    close(0)
    lifted = _lifted(out, doubts, holds) if doubts else frozenset()
    return [Token(kind, path, text, article, side or not lifted.issuperset(around)) for kind, path, text, article, side, around in out]


def _lifted(out: list[tuple], doubts: list[tuple[int, int]], holds: dict[int, set[int]]) -> frozenset[int]:
    """Doubtful elements that are not beside the article: those around it, or around most of the text.

    An element with articles is lifted if these have more text than is outside of all doubtful elements,
    one without if it has more than half of the text around it.  Where its whole class or id says that
    it is beside the article, there must be no other article, or without articles no other text, at all.
    """
    scope: dict[int, int] = defaultdict(int)  # text of an article, 0: outside of articles
    inside: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    free = [0, 0]  # outside of doubtful elements: without and with an article
    for kind, path, text, article, side, around in out:
        if kind == "t" and not side and "head" not in path:
            scope[article] += len(text)
            if not around:
                free[article > 0] += len(text)
            for d in around:
                inside[d][article] += len(text)
    found = set()
    for d, (sure, article) in enumerate(doubts):
        if holds[d]:
            mine, rest, other = sum(inside[d][a] for a in holds[d]), sum(free), free[1]
        else:
            mine = inside[d][article]
            rest = other = scope[article] - mine
        if mine > rest and not (sure == NAMED and other):
            found.add(d)
    return frozenset(found)


Key = tuple  # what a token is compared by


def _key(t: Token) -> Key:
    return (t.kind, t.path, t.text)


def deduce(pages: list[list[Token]]) -> list[Key]:
    """The root template of some pages: the valid class of tokens that stand once on each, in page order.

    Occurrence vectors are counted over all tokens; the class of vector (1, ..., 1) is the root.
    Tokens whose order differs between pages leave it, and so do tags without their partner.
    """
    vectors: dict[Key, list[int]] = defaultdict(lambda: [0] * len(pages))
    for n, page in enumerate(pages):
        for t in page:
            vectors[_key(t)][n] += 1
    classes: dict[tuple[int, ...], set[Key]] = defaultdict(set)
    for k, v in vectors.items():
        classes[tuple(v)].add(k)
    root = classes.get((1,) * len(pages), set())
    if not root:
        return []
    # one order on every page: keep the longest run that the first page's order shares with each other page
    order = [k for t in pages[0] if (k := _key(t)) in root]
    for page in pages[1:]:
        where = {_key(t): i for i, t in enumerate(page)}
        order = _increasing(order, where)
    # nesting: an element's tags belong to the template together
    opened: list[tuple[int, Key]] = []
    paired: set[int] = set()
    for i, k in enumerate(order):
        if k[0] == "<":
            opened.append((i, k))
        elif k[0] == ">":
            while opened and opened[-1][1][1] != k[1]:
                opened.pop()
            if opened:
                paired |= {opened.pop()[0], i}
    return [k for i, k in enumerate(order) if k[0] == "t" or i in paired]


def _increasing(order: list[Key], where: dict[Key, int]) -> list[Key]:
    """The longest part of ``order`` whose places increase."""
    from bisect import bisect_left

    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(order)
    for i, k in enumerate(order):
        p = where[k]
        j = bisect_left(tails, p)
        if j == len(tails):
            tails.append(p)
            ends.append(i)
        else:
            tails[j], ends[j] = p, i
        back[i] = ends[j - 1] if j else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(order[i])
        i = back[i]
    return out[::-1]


def slots(page: list[Token], template: list[Key]) -> list[list[Token]] | None:
    """The text blocks in each gap of the template, or None where the page does not have it in order."""
    out: list[list[Token]] = [[]]
    n = 0
    for t in page:
        if n < len(template) and _key(t) == template[n]:
            n += 1
            out.append([])
        elif t.kind == "t":
            out[-1].append(t)
    return out if n == len(template) else None


def _largest(page: list[Token]) -> int:
    """The article element with most text beside nothing else; 0 if there is none."""
    size: dict[int, int] = defaultdict(int)
    for t in page:
        if t.kind == "t" and t.article and not t.side:
            size[t.article] += len(t.text)
    return max(size, key=lambda a: (size[a], -a), default=0)


def own_text(page: list[Token]) -> list[str]:
    """Blocks of the article by the page's own tags."""
    chosen = _largest(page)
    return [t.text for t in page if t.kind == "t" and not t.side and t.article == chosen and "head" not in t.path]


def nested(pages: list[list[Token]], cut: list[list[list[Token]] | None]) -> set[Key]:
    """Texts of the classes that nest into one gap of the root template.

    Such a class stands at most once on a page, on SUPPORT pages and a third of them at least, and
    always in the same gap; its texts are template too, where a page has them.
    """
    seen: dict[Key, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
    often: set[Key] = set()
    for n, gaps in enumerate(cut):
        for g, blocks in enumerate(gaps or ()):
            for t in blocks:
                k = _key(t)
                if n in seen[k][g]:
                    often.add(k)
                seen[k][g].add(n)
    classes: dict[tuple[int, tuple[int, ...]], set[Key]] = defaultdict(set)
    for k, gaps in seen.items():
        if k not in often and len(gaps) == 1:
            ((g, on),) = gaps.items()
            if len(on) >= max(SUPPORT, len(pages) / 3):
                classes[g, tuple(sorted(on))].add(k)
    return {k for members in classes.values() for k in members}


def constant(pages: list[list[Token]]) -> set[Key]:
    """Texts of the classes with vectors (k, ..., k), on SUPPORT pages at least."""
    counts = [Counter(_key(t) for t in p if t.kind == "t") for p in pages]
    return {k for k, n in counts[0].items() if all(c[k] == n for c in counts)} if len(counts) >= SUPPORT else set()


def shared(pages: list[list[Token]], main: list[int]) -> set[Key]:
    """Blocks in articles that are template: their occurrence vector is above 0 for SUPPORT articles and a third of them.

    Articles with the same blocks count as one; headings are left out.
    """
    bodies = {tuple(_key(t) for t in p if t.kind == "t" and not t.side and t.article == a) for p, a in zip(pages, main, strict=True) if a}
    on: dict[Key, int] = defaultdict(int)
    for body in bodies:
        for k in set(body):
            on[k] += 1
    least = max(SUPPORT, len(bodies) / 3)
    return {k for k, n in on.items() if n >= least and not any(label.split(".")[0] in HEADINGS for label in k[1])}


def article_text(page: list[Token], article: int, template: set[Key]) -> list[str]:
    """Blocks of an article but those of the template; all of them where the template would be half of the text, as for near copies."""
    blocks = [t for t in page if t.kind == "t" and not t.side and t.article == article and "head" not in t.path]
    own = [t for t in blocks if _key(t) not in template]
    enough = 2 * sum(len(t.text) for t in own) > sum(len(t.text) for t in blocks)
    return [t.text for t in (own if enough else blocks)]


def extract(pages: list[list[Token]]) -> list[list[str]]:
    """The main text blocks of the pages of one group, read from the slots of its template."""
    main = [_largest(p) for p in pages]
    common = shared(pages, main)
    template = deduce(pages) if len(pages) >= SUPPORT else []
    cut = [slots(p, template) if template else None for p in pages]
    # without an article: every slot that differs between pages
    bare = [n for n, article in enumerate(main) if not article and cut[n] is not None]
    plain = nested(pages, cut) | constant([pages[n] for n in bare])

    def free(n: int, gap: int) -> list[Token]:
        return [t for t in cut[n][gap] if not t.side and _key(t) not in plain and "head" not in t.path]

    varying = [g for g in range(len(template) + 1) if len({tuple(t.text for t in free(n, g)) for n in bare}) > 1]
    out = []
    for n, (page, article) in enumerate(zip(pages, main, strict=True)):
        if article:
            out.append(article_text(page, article, common))
        elif cut[n] is None:
            out.append(own_text(page))
        else:
            out.append([t.text for g in varying for t in free(n, g)] or own_text(page))
    return out


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", group: int = GROUP
) -> DataFrame:
    """The main text of every page: (key, url, text, n_chars), one row per input row.

    Null and empty html give an empty text; null urls form one host; repeated rows are extracted
    each; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    slim = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h")).withColumn("site", host(F.col("u")))
    counts = slim.groupBy("site").agg(F.ceil(F.count("*") / group).cast("int").alias("groups"))
    big = counts.where("groups > 1")
    if big.count() <= 100_000:  # a host name and a number each
        big = F.broadcast(big)
    spread = F.pmod(F.xxhash64("k", "u", "h"), F.coalesce(F.col("groups"), F.lit(1))).cast("int")
    dealt = slim.join(big, "site", "left").select("site", spread.alias("part"), "k", "u", "h")
    dealt = dealt.repartition(max(parallelism(spark), 1), "site", "part").sortWithinPartitions("site", "part", "k", "u", "h")
    key_type, url_type = (dealt.schema[c].dataType.simpleString() for c in ("k", "u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def done() -> pa.RecordBatch:
            texts = ["\n".join(b) for b in extract([tokens(h) for _, _, h in held])]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in held], types[0]), pa.array([r[1] for r in held], types[1]), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["k", "u", "text", "n_chars"],
            )

        types = None
        for batch in batches:
            types = types or (batch["k"].type, batch["u"].type)
            for site, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (site, part) != at or len(held) >= 2 * group:
                    if held:
                        yield done()
                    held, at = [], (site, part)
                held.append(tuple(row))
        if held:
            yield done()

    found = dealt.mapInArrow(run, f"k {key_type}, u {url_type}, text string, n_chars long")
    return found.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")


def op3_html(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
