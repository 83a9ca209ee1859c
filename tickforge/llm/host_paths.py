"""HTML main text by consensus paths of a host.

Pass 1 parses every page into blocks of text inside containers, scores the containers (text less linked text,
passed on to the containers around it at a discount) and votes with the generalised tag-class paths of the
best: whole paths of tags with their first class, digits in it made alike. Spark sums the votes of a host; the
path with the most wins, and behind it stand the host's other templates, paths that were the best of at least a
TEMPLATE part of its pages. Pass 2 extracts every page again from the
containers on the first of these paths that it has, without the boilerplate inside them. A container inside an article stands
for the whole article, with its headings and leads. Where the path misses text of the page's own best
container, the page gets both, in page order. Only where the path leads into an article or main
element and the own container stands outside of all of them, the path alone counts; if it gives less than
LEAST_SHARE of the own container's text, the latter alone does.

Parsing takes time in proportion to the page: a tag that no `>` ends is text, and behind a quote that is never
closed tags end at the next `>`. The table of hosts is broadcast up to MAX_BROADCAST bytes; a larger one is joined
by host, the pages of hosts with many of them dealt to several tasks.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
by a line feed in page order. Null html counts as empty and gives an empty text; a null url, or one without a
host, votes with the other such pages. Repeated rows stay rows of their own; an empty table gives an empty
result; other columns are ignored.
"""

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, spread_join, texts_of, tune, written

DISCOUNT = 0.7
LINK_COST = 3
VOTES = 3
LEAST_SHARE = 0.3
#: Part of a host's pages that a further template has at least, so that a host has 20 at most.
TEMPLATE = 0.05
#: Bytes of hosts and paths that are broadcast at most.
MAX_BROADCAST = 8 << 20

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>|(</?[a-zA-Z])", re.S)
#: Behind a quote that is never closed.
PLAIN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
#: Elements whose content isn't markup.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "table", "center", "header", "footer", "nav", "aside", "form", "fieldset", "details", "dialog", "menu", "search"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "pre", "blockquote", "tr", "th", "tbody", "thead", "tfoot", "caption", "figure", "figcaption", "address", "hr", "hgroup", "summary", "option", "select", "button", "label", "svg", "object", "video", "audio", "canvas"}
#: A start tag closes these when open, up to the nearest container.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
UNWANTED = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "object", "video", "audio", "canvas", "search", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form"}
#: Words of class and id values that mark boilerplate.
MARKS = re.compile(
    r"ad|ads|adv|advert\w*|adsense|adslot|adbox|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|notices|notification\w*|alert|popup|modal|overlay|newsletter|subscri\w+|share|sharing|social|related|recommend\w*|"
    r"sidebar\w*|sidenav|breadcrumb\w*|menu\w*|nav|navbar\w*|navigation|topbar|footer\w*|masthead|comment|comments|commentlist|disqus\w*|reply|replies|respond|discussion|widget\w*|toolbar|pagination|pager|login|signup|"
    r"search\w*|hidden|tags|byline|outbrain|taboola|skip"
)
#: Words that turn a mark into a statement about the page, as in has-sidebar.
ABOUT = {"with", "without", "has", "no", "open", "closed", "enabled", "disabled"}
#: Marks that count even on an article.
READERS = {"comment", "comments", "reply", "replies", "teaser", "related"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
WORD = re.compile(r"[a-z]+")
GOOD = {"article": 1.5, "main": 1.4}


@functools.lru_cache(1 << 12)
def path_key(path: str) -> int:
    """The number that a path has in this process."""
    key = 0
    for name in path.split(">")[1:]:
        key = hash((key, name))
    return key


class Page:
    """Blocks of a page: (text, container, linked characters); containers: (parent, path key, unwanted, weight)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int]] = []
        self.containers: list[tuple[int, int, bool, float]] = [(-1, 0, False, 1.0)]
        self.names = [""]
        self.stack: list[tuple[str, int]] = []  # open block elements and the container in force inside them
        self.within: list[Counter] = [Counter()]  # open elements since each open container element, and of all
        self.text: list[str] = []
        self.links = self.linked = 0
        self.saved: list[list] = []  # what an unwanted inline element has interrupted: [tag, text, linked, depth]
        at, end, last, token = 0, len(source), source.rfind(">"), TOKEN
        while at < end:
            m = token.search(source, at) if at <= last else None
            if not m:
                self.add(source[at:])
                break
            if token is TOKEN and m[4]:
                token = PLAIN
                continue
            if m.start() > at:
                self.add(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
            elif tag in RAW:
                if not m[3].endswith("/") or tag != "iframe":
                    stop = re.compile(rf"</{tag}\b", re.I).search(source, at)
                    at = source.find(">", stop.end()) + 1 if stop else end
                    at = at or end
            else:
                self.open(tag, m[3])
        self.flush()

    def path(self, k: int) -> str:
        names = []
        while k > 0:
            names.append(self.names[k])
            k = self.containers[k][0]
        return ">".join(["", *reversed(names)])

    def push(self, tag: str, container: int) -> None:
        self.stack.append((tag, container))
        self.within[0][tag] += 1
        if tag in CONTAINERS:
            self.within.append(Counter())
        elif len(self.within) > 1:
            self.within[-1][tag] += 1

    def pop(self) -> None:
        tag, _ = self.stack.pop()
        self.within[0][tag] -= 1
        if tag in CONTAINERS:
            self.within.pop()
        elif len(self.within) > 1:
            self.within[-1][tag] -= 1

    @property
    def here(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def add(self, text: str) -> None:
        self.text.append(text)
        if self.links:
            self.linked += len(text.strip())

    def flush(self) -> None:
        if self.saved:  # an unwanted inline element ends with its block
            _, self.text, self.linked, _ = self.saved[0]
            self.saved = []
        if self.text:
            block = " ".join(html.unescape("".join(self.text)).split())
            if block:
                self.blocks.append((block, self.here, min(self.linked, len(block))))
        self.text, self.linked = [], 0

    def open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.links += 1
        elif tag in BLOCKS or " " in rest and tag not in VOID and re.search(r"\b(?:class|id|role|hidden|style|aria-hidden)\b", rest, re.I):
            if tag in BLOCKS:
                self.flush()
                self.links = 0
                closes = CLOSES.get(tag, {"p"})
                while self.stack and self.stack[-1][0] in closes:
                    self.pop()
            if tag in VOID or rest.endswith("/") and tag in ("svg", "path"):
                return
            inside = self.here
            parent = self.containers[inside]
            unwanted, name, weight = parent[2] or tag in UNWANTED, tag, GOOD.get(tag, 1.0)
            if rest.strip():
                given = {a[0].lower() or a[4].lower(): html.unescape(a[1] or a[2] or a[3]).lower() for a in ATTRIBUTE.findall(rest)}
                names = given.get("class", "").split()
                split = [WORD.findall(x) for x in (*names, given.get("id", ""))]
                words = [w for x in split if not ABOUT & set(x) for w in x]
                if tag in ("html", "body", "main", "article"):
                    unwanted |= tag == "article" and bool(READERS & set(words))
                else:
                    unwanted |= given.get("role") in ROLES or any(MARKS.fullmatch(w) for w in words)
                unwanted |= "hidden" in given or given.get("aria-hidden") == "true" or bool(HIDDEN.search(given.get("style", "")))
                if names:
                    name += "." + re.sub(r"\d+", "#", names[0]).replace(">", "")
                if any(w in ("content", "article", "post", "entry", "story") for w in words):
                    weight = max(weight, 1.2)
            if tag == "header" and not self.within[0]["article"] and not self.within[0]["main"]:
                unwanted = True
            if tag not in BLOCKS:
                if unwanted and not parent[2] and not self.saved:
                    self.saved.append([tag, self.text, self.linked, 0])
                    self.text, self.linked = [], 0
                elif self.saved and tag == self.saved[0][0]:
                    self.saved[0][3] += 1
                return
            if tag in CONTAINERS or unwanted != parent[2]:
                self.containers.append((inside, hash((parent[1], name)), unwanted, weight))
                self.names.append(name)
                inside = len(self.containers) - 1
            self.push(tag, inside)
        elif self.saved and tag == self.saved[0][0]:
            self.saved[0][3] += 1

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in BLOCKS:
            if self.saved and tag == self.saved[0][0]:
                self.saved[0][3] -= 1
                if self.saved[0][3] < 0:
                    _, self.text, self.linked, _ = self.saved.pop()
            return
        self.flush()
        self.links = 0
        if (self.within[0] if tag in CONTAINERS else self.within[-1])[tag]:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def scores(self) -> dict[int, float]:
        """Containers with text by score, boilerplate and what is inside it left out."""
        worth: list[float | None] = [None] * len(self.containers)
        for text, k, linked in self.blocks:
            if not self.containers[k][2]:
                worth[k] = (worth[k] or 0.0) + len(text) - LINK_COST * linked
        for k in range(len(worth) - 1, 0, -1):  # containers come after those around them
            if worth[k] is not None:
                worth[self.containers[k][0]] = (worth[self.containers[k][0]] or 0.0) + DISCOUNT * worth[k]
        return {k: w * self.containers[k][3] for k, w in enumerate(worth) if w is not None}

    def votes(self) -> list[tuple[str, float]]:
        """The best paths and their share of the best one's score."""
        by: dict[int, list] = {}
        for k, s in self.scores().items():
            if s > 0:
                by.setdefault(self.containers[k][1], [k, 0.0])[1] += s
        most = sorted(by.values(), key=lambda x: -x[1])
        some = most[:VOTES] + [x for x in most[VOTES:] if x[1] == most[VOTES - 1][1]]  # ties are told apart by path
        best = sorted(((self.path(k), s) for k, s in some), key=lambda x: (-x[1], x[0]))[:VOTES]
        return [(p, s / best[0][1]) for p, s in best]

    def articles(self) -> tuple[list[int], list[bool]]:
        """Of each container: the outermost article around it, or itself; whether it is or is in an article or main."""
        around, marked = [], []
        for k, (parent, _, _, weight) in enumerate(self.containers):
            inner = parent >= 0 and self.containers[around[parent]][3] == GOOD["article"]
            around.append(around[parent] if inner else k)
            marked.append(weight >= GOOD["main"] or parent >= 0 and marked[parent])
        return around, marked

    def inside(self, chosen: set[int]) -> list[int]:
        """The blocks in the chosen containers, boilerplate left out."""
        held = []
        for k, (parent, _, unwanted, _) in enumerate(self.containers):
            held.append(not unwanted and (k in chosen or parent >= 0 and held[parent]))
        return [i for i, (_, k, _) in enumerate(self.blocks) if held[k]]

    def extract(self, paths: list[str] | None) -> str:
        def size(blocks) -> int:
            return sum(len(self.blocks[i][0]) + 1 for i in blocks)

        scores = self.scores()
        around, marked = self.articles()
        best = around[max(scores, key=lambda k: (scores[k], -k))] if scores else -1
        own = self.inside({best})
        blocks, on_path = [], set()
        for path in paths or ():
            key = path_key(path)
            on_path = {around[k] for k, x in enumerate(self.containers) if x[1] == key and not x[2]}
            if on_path and (blocks := self.inside(on_path)):
                break
        if not (blocks and all(marked[k] for k in on_path) and not marked[best]):
            blocks = sorted({*own, *blocks})
        elif size(blocks) < LEAST_SHARE * size(own):
            blocks = own
        return "\n".join(self.blocks[i][0] for i in blocks)


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the path with the most votes of each host of pages with host and html, and its other templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, votes, first = [], [], [], []
            for host, source in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                for k, (path, vote) in enumerate(Page(source).votes()):
                    hosts.append(host)
                    paths.append(path)
                    votes.append(round(vote * 1000))
                    first.append(int(k == 0))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64()), pa.array(first, pa.int64())], names=["host", "path", "vote", "first"])

    votes = pages.select("host", "html").mapInArrow(lean(run), "host string, path string, vote long, first long")
    sums = votes.groupBy("host", "path").agg(F.sum("vote").alias("vote"), F.sum("first").alias("first"))
    sums = written(sums, "path-votes")
    hosts = sums.groupBy("host").agg(F.max(F.struct("vote", "path")).alias("best"), F.sum("first").alias("pages"))
    kept = sums.join(hosts, "host").where((F.col("path") == F.col("best.path")) | (F.col("first") >= F.lit(TEMPLATE) * F.col("pages")))
    ranked = F.sort_array(F.collect_list(F.struct("vote", "path")), asc=False)
    return kept.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, url, text) of every page."""
    tune(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    pages = pages.select(F.col(id_col).alias("page_id"), "url", "html", host.alias("host"))
    paths = written(winning_paths(pages), "host-paths")
    size = paths.agg(F.sum(F.length("host") + F.length(F.array_join("paths", ">")))).first()[0] or 0
    if size <= MAX_BROADCAST:
        both = pages.join(F.broadcast(paths), "host", "left")
    else:
        both = spread_join(pages, paths, ["host"], pages.count(), ["page_id", "url"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source).extract(found) for source, found in zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return both.select("page_id", "url", "html", "paths").mapInArrow(lean(run), "page_id long, url string, text string")
