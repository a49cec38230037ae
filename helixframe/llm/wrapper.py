"""Main-text extraction by inferred wrappers: union-free expressions over a host's pages.

A page becomes a nested token expression: element tokens (tag, class, id) and
text slots, with inline markup folded into the text and equal neighbours folded
into repeated groups. Expressions of one host are aligned one after another;
siblings are matched in order by a longest common subsequence of any length,
and a mismatch becomes an optional group, a run of a sibling a repeated one,
differing texts a slot. The result, the host's wrapper, also carries how many
pages hold a node, and per slot how many of its blocks are mostly links and
whether its text ever differs.

What is kept follows from the wrapper, and is the same for one page and for many
where a page marks its article:

* in an ``article`` or ``main`` element everything is kept but marked elements
  (navigation, forms, notices, adverts, sidebars, comments and the like, by tag
  or by a class, id or role that names them); of a header in it the headings; and
  a ``section`` whose name may as well be a heading's (``discussion``, ``notice``,
  ``search``) is kept, less slots of links;
* elsewhere slots most of whose blocks are links go, and slots with one text on
  most pages of the host, and on two at least, unless they lie in the body of
  varying text between its first and its last slot, as headings do that all
  pages share;
* a class, id or role names an element by its last word (``site-header``, not
  ``header-title``), and is no more than a tie-breaker: an element around an
  article, or around most of the host's varying text, is kept, as is a form.

Inference is distributed: each task aligns the pages it reads into one partial
wrapper a host, partial wrappers are aligned in two levels (so a host that has
a third of all pages spreads over tasks), and all pages take part. A wrapper is
bounded: a node with more than ``KIDS`` kinds of children holds its rare ones
as one group a tag. Tasks receive the decisions of the hosts with most pages
once, up to ``BROADCAST`` bytes; pages of the many small hosts beyond meet theirs
in a join.

Defined cases: null html has an empty text; markup that never closes, closes
twice or is cut off is repaired as browsers do for paragraphs and list items;
below ``DEPTH`` levels of nesting elements are siblings, each still ended by its own end tag; a page whose slots all
look like boilerplate has an empty text; a null URL is a host of its own;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed

#: Decisions of up to so many bytes, and of so many hosts, are broadcast.
BROADCAST = 8 << 20
HELD = 4096
#: Wrapper nodes a task keeps at once; beyond it, partial wrappers are emitted and begun anew.
NODES = 1_000_000
#: A text equal on at least this many pages, the fewest that can tell, and on most of the host's, is fixed.
TEMPLATE_PAGES = 2
#: Children of a wrapper node that are told apart.
KIDS = 64
#: Levels of nested elements.
DEPTH = 120

_WORDS = re.compile(r"[a-z]+")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|math|iframe|select|title)\b[^>]*(?:/>|>(?:.*?</(?P=raw)\s*>|.*$)|$)"
    r"|<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# Elements whose text runs on in the block around them.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag of the key's set ends an open element of the key.
ENDS = {
    "p": set("address article aside blockquote details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split()),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option"},
}
# Elements and words of class, id or role that mark what isn't the article.
BOILERPLATE_TAGS = set("nav footer aside button input menu dialog object".split())
COMMENT_WORDS = set("comment comments commentlist discussion disqus reply replies respond reader readers".split())
BOILERPLATE_WORDS = COMMENT_WORDS | set(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer colophon"
    " sidebar aside widget widgets related recommended recommendations cookie cookies consent gdpr notice notices alert alerts"
    " popup modal overlay newsletter subscribe subscription signup login share sharing social toolbar pagination pager legal disclaimer copyright form search contentinfo complementary hidden".split()
)
# Words of the above that a section of an article may bear as its subject.
SUBJECT_WORDS = set("discussion reader readers search notice notices legal disclaimer copyright form menu navigation related recommended social sharing banner alert alerts consent subscription promotion header sidebar".split())
# Words that say where or in what a thing is, and not what it is; after "related", those that name what is listed.
PLACE_WORDS = set("area bar block blocks body bottom box buttons center col column container content group holder icons inner item items left link links list outer panel right row section text top unit wrap wrapper zone".split())
LISTED_WORDS = set("articles news pages posts reading stories topics".split())
NEGATING_WORDS = set("has is no not with without".split())
ARTICLE_WORDS = set("article content post entry story page".split())
MAIN_TAGS = {"article", "main"}
# Elements of a block or a list, which are parts of a body and never the body itself.
PARTS = set("p blockquote pre address figure figcaption details summary ul ol dl li dt dd table caption thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

IN_ARTICLE, ELSEWHERE = 1, 2


class Node:
    """An element: its token, children in order, and for a block of text the text and the characters in links."""

    __slots__ = ("key", "kids", "text", "links")

    def __init__(self, key: str, text: list[str] | None = None):
        self.key, self.kids, self.text, self.links = key, [], text, 0


def _key(tag: str, attrs: str) -> str:
    """The token of an element: its tag and the names in class, id and role, less their digits."""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return tag
    names = set()
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            names.add("hidden")
        elif name in ("class", "id", "role"):
            names.update("-".join(_WORDS.findall(v)) for v in value.split())
    return " ".join([tag, *sorted(names - {""})])


@lru_cache(maxsize=10_000)
def named(name: str) -> str:
    """The boilerplate word by which a class, id or role names its element; empty if none does."""
    words = name.split("-")
    if words[0] in NEGATING_WORDS or words[-1] in ("header", "masthead") and ARTICLE_WORDS & set(words):
        return ""
    if words[0] == "related" and words[-1] in LISTED_WORDS:
        return "related"
    while len(words) > 1 and words[-1] in PLACE_WORDS:
        words.pop()
    return words[-1] if words[-1] in BOILERPLATE_WORDS else ""


@lru_cache(maxsize=10_000)
def marks(key: str) -> tuple[str, frozenset[str]]:
    """An element's tag and the boilerplate words that name it."""
    tag, _, names = key.partition(" ")
    if tag in ("body", "html") or tag in HEADINGS:
        return tag, frozenset()
    return tag, frozenset(w for n in names.split() if (w := named(n))) | ({"form"} if tag == "form" else set())


def general(key: str) -> str:
    """The token with which rare siblings are held together: the tag and what marks it."""
    tag, words = marks(key)
    return key if key == "#" else " ".join([tag, "*", *sorted(words)])


def parse(page: str | None) -> Node:
    """The tree of a page's elements and text blocks, without what is never text."""
    root = Node("")
    stack, deep, block, link = [root], [], None, 0  # deep: tags of open elements below the last level
    for m in _TOKEN.finditer(page or ""):
        text = m["text"]
        if text is not None:
            if block is None:
                if text.isspace():
                    continue
                block = Node("#", [])
                stack[-1].kids.append(block)
            block.text.append(text)
            if link:
                block.links += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                link = 0 if m["end"] else 1
            if block is not None:
                block.text.append(" " if tag == "br" else "")
            continue
        block = None
        if m["end"]:
            if tag in deep:
                while deep.pop() != tag:
                    pass
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].key.split(" ", 1)[0] == tag:
                        del stack[i:]
                        deep.clear()
                        break
            link = 0
            continue
        while deep and tag in ENDS.get(deep[-1], ()):
            deep.pop()
        while not deep and len(stack) > 1 and tag in ENDS.get(stack[-1].key.split(" ", 1)[0], ()):
            stack.pop()
        node = Node(_key(tag, m["attrs"]))
        stack[-1].kids.append(node)
        if tag not in VOID and not m["attrs"].endswith("/"):
            if len(stack) < DEPTH:
                stack.append(node)
            else:
                deep.append(tag)
    return root


def clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


# A wrapper node is a list [key, optional, repeated, kids, stats]; stats are the
# pages that hold it and, of a text slot, also characters, characters in links,
# least and greatest hash, blocks, and blocks that are mostly links.


def wrapped(node: Node) -> list:
    """The expression of one page, with runs of one token folded into a repeated group."""
    if node.key == "#":
        text = clean(node.text)
        h = zlib.crc32(text.encode())
        links = min(len(text), node.links)
        return ["#", False, False, [], [1, len(text), links, h, h, 1, int(links * 2 > len(text))]]
    kids: list[list] = []
    for kid in node.kids:
        _joining(kids, wrapped(kid))
    return [node.key, False, False, _bounded(kids), [1]]


def _joining(kids: list[list], one: list) -> None:
    """Append a sibling, or fold it into the last one if their tokens are equal."""
    if kids and kids[-1][0] == one[0]:
        kids[-1] = merged(kids[-1], one, same_page=True)
        kids[-1][2] = True
    else:
        kids.append(one)


def _bounded(kids: list[list]) -> list[list]:
    """The siblings, rare ones in one repeated group for each general token if there are more than ``KIDS``."""
    if len(kids) <= KIDS:
        return kids
    common = set(sorted(range(len(kids)), key=lambda k: (-kids[k][4][0], k))[: KIDS // 2])
    out: list[list] = []
    groups: dict[str, int] = {}
    for k, kid in enumerate(kids):
        key = kid[0] if k in common and "*" not in kid[0] else general(kid[0])
        kid = [key, kid[1] or k not in common, *kid[2:]]
        if k in common and "*" not in key:
            out.append(kid)
        elif key in groups:
            at = groups[key]
            out[at] = merged(out[at], kid, same_page=True)
            out[at][2] = True
        else:
            groups[key] = len(out)
            out.append(kid)
    return out


def aligned(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Longest common subsequence of two token lists, as index pairs; None where one side has no match.

    Bit-parallel: a row of the usual table is one number, a bit an entry of
    ``b`` that is 0 where the length grows. Every ``isqrt(n)``-th row is kept and the
    others are made anew on the way back, so long lists need little memory.
    """
    if a == b:
        return [(i, i) for i in range(len(a))]
    n, m = len(a), len(b)
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << m) - 1

    def rows(row: int, s: int, e: int) -> list[int]:
        out = [row]
        for x in a[s:e]:
            hit = row & at.get(x, 0)
            row = ((row + hit) | (row - hit)) & full
            out.append(row)
        return out

    step = isqrt(n) + 1
    kept, row = [], full
    for s in range(0, n, step):
        kept.append(row)
        row = rows(row, s, min(n, s + step))[-1]
    out: list[tuple[int | None, int | None]] = []
    i, j, at_chunk, table = n, m, -1, []
    while i and j:
        c = (i - 1) // step
        if c != at_chunk:
            at_chunk, table = c, rows(kept[c], c * step, min(n, c * step + step))
        if table[i - c * step] >> (j - 1) & 1:
            j -= 1
            out.append((None, j))
        elif i > 1 and not table[i - 1 - c * step] >> (j - 1) & 1:
            i -= 1
            out.append((i, None))
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    out += [(None, k) for k in range(j - 1, -1, -1)] + [(k, None) for k in range(i - 1, -1, -1)]
    return out[::-1]


def merged(a: list, b: list, same_page: bool = False) -> list:
    """The expression that covers both; their keys are equal."""
    x, y = a[4], b[4]
    pages = max(x[0], y[0]) if same_page else x[0] + y[0]
    if a[0] == "#":
        return ["#", a[1] or b[1], a[2] or b[2], [], [pages, x[1] + y[1], x[2] + y[2], min(x[3], y[3]), max(x[4], y[4]), x[5] + y[5], x[6] + y[6]]]
    kids: list[list] = []
    for i, j in aligned([k[0] for k in a[3]], [k[0] for k in b[3]]):
        if i is None or j is None:
            one = b[3][j] if i is None else a[3][i]
            one = [one[0], True, *one[2:]]
        else:
            one = merged(a[3][i], b[3][j], same_page)
        _joining(kids, one)
    return [a[0], a[1] or b[1], a[2] or b[2], _bounded(kids), [pages]]


def size(wrapper: list) -> int:
    return 1 + sum(map(size, wrapper[3]))


class _Slot:
    """A text slot on the way to a decision; ``path`` are the nodes around it, from the root."""

    __slots__ = ("out", "path", "linked", "fixed", "chars", "article", "words", "tagged", "head", "subject")


def decide(wrapper: list) -> list:
    """The wrapper as nested [key, kids]; a text slot is ["#", where its text counts]."""
    slots: list[_Slot] = []

    @cache
    def around_article(at: int) -> bool:
        return any(k[0] != "#" and (marks(k[0])[0] in MAIN_TAGS and not marks(k[0])[1] or around_article(id(k))) for k in by_id[at][3])

    def holds_article(node: list) -> bool:
        return around_article(id(node))

    by_id: dict[int, list] = {}

    def noted(node: list) -> None:
        by_id[id(node)] = node
        for k in node[3]:
            noted(k)

    noted(wrapper)

    def walk(node: list, path: tuple[int, ...], article: bool, tagged: bool, words: tuple[tuple[int, bool], ...], head: bool, subject: bool = False) -> list:
        if node[0] == "#":
            pages, chars, links, least, most, count, linked = node[4]
            s = _Slot()
            s.out, s.path, s.article, s.tagged, s.words, s.head = ["#", 0], path, article, tagged, words, head
            s.linked, s.chars, s.subject = linked * 2 > count, chars - links, subject
            s.fixed = least == most and pages >= TEMPLATE_PAGES and 2 * pages > wrapper[4][0]
            slots.append(s)
            return s.out
        tag, found = marks(node[0])
        path = (*path, len(seen))
        seen.append(node)
        tagged = tagged or (tag in BOILERPLATE_TAGS or tag == "header" and not article) and not holds_article(node)
        subject = subject or article and tag == "section" and bool(found) and found <= SUBJECT_WORDS
        if found and not holds_article(node) and not (article and tag == "section" and found <= SUBJECT_WORDS):
            words = (*words, (path[-1], bool(found & COMMENT_WORDS or "hidden" in found)))
        # a header inside the article keeps its headings only
        head = tag not in HEADINGS and (head or tag == "header" and article)
        article = article or tag in MAIN_TAGS and not found
        return [node[0], [walk(k, path, article, tagged, words, head, subject) for k in node[3]]]

    seen: list[list] = []
    tree = walk(wrapper, (), False, False, (), False)
    # words are no more than a tie-breaker: not for what holds most of the varying text
    free = [s for s in slots if not (s.tagged or s.linked or s.fixed or any(comment for _, comment in s.words))]
    held: dict[int, int] = {}
    for s in free:
        for p in s.path:
            held[p] = held.get(p, 0) + s.chars
    total = sum(s.chars for s in free)
    rest = []
    for s in slots:
        named_out = any(comment or 2 * held.get(p, 0) <= total for p, comment in s.words)
        if s.tagged or named_out or s.head:
            continue
        if s.article:
            s.out[1] = IN_ARTICLE if not (s.subject and s.linked) else 0
        elif not s.linked:
            rest.append(s)
    varying = [s for s in rest if not s.fixed]
    if varying:
        # the body: the innermost container of most of the varying text, from its first slot to its last
        inside: dict[int, int] = {}
        for s in varying:
            for p in s.path:
                inside[p] = inside.get(p, 0) + s.chars
        most = sum(s.chars for s in varying)
        body = max((p for p in inside if 5 * inside[p] >= 3 * most and marks(seen[p][0])[0] not in PARTS), default=0)
        own = [k for k, s in enumerate(rest) if body in s.path and not s.fixed]
        rest = [s for k, s in enumerate(rest) if not s.fixed or own and body in s.path and own[0] < k < own[-1]]
    for s in rest:
        s.out[1] = ELSEWHERE
    return tree


def _walk(page: Node, decided: list, blocks: list[tuple[int, str]]) -> None:
    # runs of one token belong to one repeated group of the wrapper
    groups: list[list[Node]] = []
    for kid in page.kids:
        if groups and groups[-1][0].key == kid.key:
            groups[-1].append(kid)
        else:
            groups.append([kid])
    by_key = {kid[0]: kid for kid in reversed(decided[1])}
    for i, j in aligned([g[0].key for g in groups], [k[0] for k in decided[1]]):
        if i is None:
            continue
        key = groups[i][0].key
        slot = decided[1][j] if j is not None else by_key.get(general(key)) or by_key.get(key)
        for kid in groups[i] if slot is not None else ():
            if kid.key != "#":
                _walk(kid, slot, blocks)
            elif slot[1] and (text := clean(kid.text)):
                blocks.append((slot[1], text))


def extract(page: Node, decided: list) -> list[str]:
    """The kept blocks of a page in page order, walking it along its wrapper."""
    blocks: list[tuple[int, str]] = []
    _walk(page, decided, blocks)
    where = min((w for w, _ in blocks), default=IN_ARTICLE)
    return [text for w, text in blocks if w == where]


def _json(value: list) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(map(_json, held.values()), pa.string())], ["host", "wrapper"])

    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                one = wrapped(parse(page))
                held[host] = merged(held[host], one) if host in held else one
            if sum(map(size, held.values())) > NODES:
                yield emit()
                held.clear()
    yield emit()


def _merged_group(group: pa.Table) -> pa.Table:
    out = None
    for text in sorted(group["wrapper"].to_pylist()):
        one = json.loads(text)
        out = one if out is None else merged(out, one)
    return pa.table({"host": group["host"][:1], "wrapper": pa.array([_json(out)], pa.string())})


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, html): one wrapper a host, as JSON."""
    shape = "host string, wrapper string"
    parts = pages.select("host", "html").mapInArrow(_partial, shape)
    salted = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(64)).alias("salt")).applyInArrow(_merged_group, shape)
    return salted.groupBy("host").applyInArrow(_merged_group, shape)


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wrappers = [json.loads(w) for w in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([w[4][0] for w in wrappers], pa.int64()), pa.array([_json(decide(w)) for w in wrappers], pa.string())], ["host", "pages", "decided"])


_loaded = lru_cache(maxsize=512)(json.loads)


def _extracted(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """Texts of pages; ``of`` gives the decisions of each row of a batch as JSON."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts = ["\n\n".join(extract(parse(page), _loaded(d))) if page else "" for page, d in zip(part.column("html").to_pylist(), of(part), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) per row."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "://([^/?#]*)", 1))
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    decided = checkpointed(infer(pages).mapInArrow(_decisions, "host string, pages long, decided string"))
    known, used = {}, 0
    for r in decided.orderBy(F.desc("pages"), "host").limit(HELD).collect():
        used += len(r["host"].encode()) + len(r["decided"].encode())
        if used > BROADCAST:
            break
        known[r["host"]] = r["decided"]
    sent = df.sparkSession.sparkContext.broadcast(known)

    def by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _extracted(batches, lambda part: [sent.value[h] for h in part.column("host").to_pylist()])

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _extracted(batches, lambda part: part.column("decided").to_pylist())

    shape = "id long, url string, text string"
    if decided.count() == len(known):
        out = pages.mapInArrow(by_host, shape)
    else:
        names = F.broadcast(df.sparkSession.createDataFrame([(h,) for h in known], "host string"))
        near = pages.join(names, "host", "left_semi").select("id", "url", "html", "host").mapInArrow(by_host, shape)
        far = pages.join(names, "host", "left_anti").join(decided.select("host", "decided"), "host").select("id", "url", "html", "decided").mapInArrow(by_row, shape)
        out = near.unionByName(far)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
