"""Main-text extraction from HTML by consensus host paths.

1. Each page's containers are scored by the text of their own blocks, without links; the best path votes. A path is the tags
   and classes from the root, with digits generalised.
2. Votes are added up per host in Spark, and each host's first path wins.
3. Pages are read again with their host's path; a page without it uses its own best container.

A page is read in one pass, in time and memory linear in its length, whatever its nesting: elements know their parent only,
paths are numbers of (parent path, step), and open elements are found by their tag.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernwerk.llm import kernels as K
from fernwerk.storage import materialise

#: A host with more than a HOT-th of all pages is dealt over SALTS keys in the join with the hosts' paths; there are fewer than HOT of them.
HOT, SALTS = 1000, 256
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template iframe object svg math canvas select option datalist textarea button head title audio video map".split())
#: Elements that frame a page rather than carry its article.
FRAME = frozenset("nav aside footer dialog menu".split())
#: Elements inside a form that belong to its controls.
CONTROLS = frozenset("label legend output meter progress fieldset".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div form main section td".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Words of class and id names of what stands beside an article.
ASIDE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split())
#: Of these, words that say so at the beginning of a longer name too: comment-list, sidebar-left.
SURE = frozenset("breadcrumb breadcrumbs comment comments cookie cookies disqus navbar newsletter pagination replies sidebar".split())
#: Before such a word they say that the thing is there, or not, elsewhere on the page: with-sidebar, no-comments.
ABOUT = frozenset("has have with without no not is show hide hidden left right under over above below main".split())
#: Names of what carries an article.
BODY = frozenset("article body content entry main post story text".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
#: An element dropped by a part of its name only, or a form, is kept after all if it holds this share of the page's text.
MOST = 0.7
#: A parent takes its children's place if the best child has less than this share of the text of both.
LEAD = 0.8
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TAIL = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_DIGITS = re.compile("[0-9]+")
_WORDS = re.compile(r"[^a-z0-9]+")
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}


@dataclass(slots=True)
class Node:
    tag: str
    path: int
    drop: bool  # nothing below is text of the article
    container: int  # number of the nearest container
    doubt: int  # number of the nearest element that may have to go, 0 for none
    link: bool


@dataclass(slots=True)
class Piece:
    text: str
    container: int
    doubt: int
    link: bool
    block: int  # pieces of one block stand in one line


@dataclass
class Page:
    """Text pieces; containers and doubtful elements with their parents; paths by (parent, step)."""

    pieces: list[Piece] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [-1])  # of each container
    path: list[int] = field(default_factory=lambda: [0])  # of each container
    doubts: list[tuple[int, bool]] = field(default_factory=lambda: [(-1, False)])  # parent, and whether its whole name says so
    steps: dict[tuple[int, str], int] = field(default_factory=dict)

    def names(self, path: int) -> str:
        """The path as text."""
        back = {i: x for x, i in self.steps.items()}
        out = []
        while path:
            path, step = back[path]
            out.append(step)
        return "".join(f">{s}" for s in reversed(out))

    def number(self, path: str) -> int:
        """The number of a path given as text, -1 if the page has none of that path."""
        at = 0
        for step in path.split(">")[1:]:
            at = self.steps.get((at, step), -1)
            if at < 0:
                break
        return at


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)}


def beside(names: str) -> int:
    """2 if a whole class or id name says that the element stands beside the article, 1 if the beginning or end of one does."""
    tokens = [[w for w in _WORDS.split(t) if w] for t in names.split()]
    if any(w[0] in (SURE if len(w) > 1 else ASIDE) for w in tokens if w):
        return 2
    part = any(w[0] not in ABOUT and (w[0] in ASIDE or w[-1] in ASIDE) for w in tokens if len(w) > 1)
    return int(part and not any(len(w) == 1 and w[0] in BODY for w in tokens))


def read(page: str) -> Page:
    """The page's text pieces that may belong to an article, and its containers."""
    out = Page()
    stack = [Node("", 0, False, 0, 0, False)]
    where: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each tag
    block, at, size = 0, 0, len(page)
    last_cdata = page.rfind("]]>")
    strict = True  # until a quotation mark is never closed

    def add(text: str) -> None:
        top = stack[-1]
        if text and not top.drop:
            out.pieces.append(Piece(_html.unescape(text), top.container, top.doubt, top.link, block))

    def pop_to(n: int) -> None:
        for node in stack[n:]:
            where[node.tag].pop()
        del stack[n:]

    def last(tags: tuple[str, ...]) -> int:
        return max((where[t][-1] for t in tags if where[t]), default=0)

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        if page.startswith("<!--", begin):
            add(page[at:begin])
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", begin) and last_cdata > begin:
            add(page[at:begin])
            end = page.find("]]>", begin)
            add(_html.escape(page[begin + 9 : end]))
            at = end + 3
            continue
        m = _NAME.match(page, begin)
        if m is None:
            if page.startswith(("<!", "<?"), begin):
                end = page.find(">", begin)
                add(page[at:begin])
                at = size if end < 0 else end + 1
            else:
                add(page[at : begin + 1])
                at = begin + 1
            continue
        tail = _TAIL.match(page, m.end()) if strict else None
        if tail is None:
            strict = False
            end = page.find(">", m.end())
            if end < 0:  # no tag is closed from here on
                add(page[at:])
                break
            end += 1
        else:
            end = tail.end()
        add(page[at:begin])
        at = end
        tag, rest = m[2].lower(), page[m.end() : end - 1]
        if m[1]:
            if tag in BLOCK:
                block += 1
            if where[tag]:
                pop_to(where[tag][-1])
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            block += 1
            if where["p"] and where["p"][-1] > max(last(("li", "table")), stack[-1].container and last(tuple(CONTAINER))):
                pop_to(where["p"][-1])  # a block ends an open paragraph
        if tag in _CLOSES and (i := last(_CLOSES[tag])) > last(_SCOPE.get(tag, ())):
            if tag in ("tr", "td", "th", "dt", "dd"):  # the outermost that is open within the scope
                i = min(x for t in _CLOSES[tag] for x in where[t][-1:] if x > last(_SCOPE.get(tag, ())))
            pop_to(i)
        if tag in VOID:
            continue
        attrs = _attributes(rest) if rest.strip(" /\n\t") else {}
        top = stack[-1]
        name = " ".join(sorted(attrs.get("class", "").lower().split()))
        inside = bool(where["article"] or where["main"])
        drop = top.drop or tag in HIDDEN or tag in FRAME or (tag == "header" and not inside) or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        drop = drop or (tag in CONTROLS and bool(where["form"]))
        doubt = top.doubt
        if not drop and tag not in ("html", "body", "article", "main"):
            sure = beside(f"{name} {attrs.get('id', '').lower()}") if attrs else 0
            if sure or tag == "form" or attrs.get("role", "").lower() == "form":
                out.doubts.append((doubt, sure == 2))
                doubt = len(out.doubts) - 1
        step = tag + (f".{_DIGITS.sub('#', name.replace(' ', '.').replace('>', ''))}" if name else "")
        path = out.steps.setdefault((top.path, step), len(out.steps) + 1)
        container = top.container
        if tag in CONTAINER:
            container = len(out.path)
            out.path.append(path)
            out.parent.append(top.container)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if rest.endswith("/") and tag in ("svg", "math"):
            continue
        where[tag].append(len(stack))
        stack.append(Node(tag, path, drop, container, doubt, top.link or tag == "a"))
    return settled(out)


def settled(page: Page) -> Page:
    """Without the pieces of doubtful elements, but for those that hold most of the page's text.

    An element that only a part of its name, or being a form, speaks against is kept if it holds at least MOST of the text; one that
    its whole name speaks against, only if nothing would be left.
    """
    n = len(page.doubts)
    if n == 1:
        return page
    held = [0] * n
    for p in page.pieces:
        held[p.doubt] += 0 if p.link else len(p.text.strip())
    total = sum(held)
    for i in range(n - 1, 0, -1):
        held[max(page.doubts[i][0], 0)] += held[i]

    def kept(spare: bool) -> list[bool]:
        keep = [True] * n
        for i in range(1, n):
            above, sure = page.doubts[i]
            keep[i] = keep[max(above, 0)] and total > 0 and held[i] >= MOST * total and (spare or not sure)
        return keep

    for spare in (False, True):
        keep = kept(spare)
        pieces = [p for p in page.pieces if keep[p.doubt]]
        if any(not p.link and p.text.strip() for p in pieces):
            break
    page.pieces = pieces
    return page


def promote(path: str) -> str:
    """The path to the outermost article or main element, where there is one."""
    steps = path.split(">")
    for i, s in enumerate(steps):
        if s.partition(".")[0] in ("article", "main"):
            return ">".join(steps[: i + 1])
    return path


def best_path(page: Page) -> tuple[str, float]:
    """The container path with the most text: a container's own text counts whole and half for the one around it; link text counts against.

    Where an article's text is spread over containers side by side, the path of what holds them is taken. Ties: the first on the page.
    """
    score: dict[int, float] = defaultdict(float)
    text = [0] * len(page.path)
    for p in page.pieces:
        n = len(p.text.strip())
        if not n:
            continue
        n = -n if p.link else n
        own = p.container
        text[own] += n
        score[page.path[own]] += n
        if page.parent[own] >= 0:
            score[page.path[page.parent[own]]] += n / 2
    if not score:
        return "", 0.0
    best = min(score, key=lambda x: (-score[x], x))
    top, path = score[best], page.names(best)
    if promote(path) == path:
        total: dict[int, int] = defaultdict(int)  # of all containers of a path
        above: dict[int, int] = {}
        for i in range(len(text) - 1, 0, -1):  # children come after their parents
            text[page.parent[i]] += text[i]
            total[page.path[i]] += text[i]
            above[page.path[i]] = page.path[page.parent[i]]
        while above.get(best) and total[best] < LEAD * total[above[best]]:
            best = above[best]
        path = page.names(best)
    return promote(path), top


def main_text(page: str | None, path: str | None = None) -> str:
    """The blocks of the article, one a line: under ``path``, or under the page's own best container if it has none of that path."""
    got = read(page or "")

    def under(path: str | None) -> list[Piece]:
        wanted = got.number(path) if path is not None else -1
        if wanted < 0:
            return []
        inside = [x == wanted for x in got.path]
        for i in range(1, len(inside)):  # parents come before their children
            inside[i] = inside[i] or inside[got.parent[i]]
        return [p for p in got.pieces if inside[p.container]]

    pieces = under(path) if path else []
    if not any(p.text.strip() for p in pieces):
        pieces = under(best_path(got)[0])
    blocks: list[list[str]] = []
    last = None
    for p in pieces:
        if p.block == last:
            blocks[-1].append(p.text)
        else:
            blocks.append([p.text])
            last = p.block
    return "\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.chunks(batches, "html", 4 << 20):
        found = [best_path(read(x)) if x else ("", 0.0) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([p for p, _ in found]), pa.array([s for _, s in found], pa.float64())], ["host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.chunks(batches, "html", 4 << 20):
        texts = [main_text(h, p) for h, p in zip(b.column("html").to_pylist(), b.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column("path")], ["page_id", "url", "text", "n_chars", "host_path"])


def host_of(url: str = "url") -> F.Column:
    return F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, score): how many pages of a host found a path best, and the sum of their scores; '' is no path."""
    cast = pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(K.tidy(_vote), "host string, path string, score double")
    return cast.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum(F.round("score")).alias("score"))


def winners(added: DataFrame) -> DataFrame:
    """(host, path, votes): the container path that most pages of the host vote for; then the one with more text, then the first by name."""
    return added.where("path <> ''").groupBy("host").agg(F.max_by(F.struct("path", "votes"), F.struct("votes", "score", "path")).alias("x")).select("host", "x.path", "x.votes")


def host_paths(pages: DataFrame) -> DataFrame:
    return winners(votes(pages))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, host_path) of every page, from its whole html.

    Character references are decoded, white space within a block is one space, blocks are trimmed and joined by one line feed.
    Null or empty html, and pages without an article, give the empty text. Rows are read one by one, so repeated
    ids get a row each; a null url is a host of its own name ''. Pages of hot hosts are dealt over SALTS keys.
    """
    added = materialise(votes(pages), "votes")
    total = added.agg(F.coalesce(F.sum("votes"), F.lit(0))).first()[0]
    hot = [r["host"] for r in added.groupBy("host").agg(F.sum("votes").alias("n")).where(F.col("n") > max(1, total // HOT)).limit(HOT).collect()]
    is_hot = F.col("host").isin(*hot) if hot else F.lit(False)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    paths = winners(added).select("host", "path", F.explode(salts).alias("salt"))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of().alias("host")).withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).otherwise(0))
    kind = {n: rows.schema[n].dataType.simpleString() for n in ("page_id", "url")}
    return rows.join(paths, ["host", "salt"], "left").select("page_id", "url", "html", "path").mapInArrow(K.tidy(_extract), f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long, host_path string")
