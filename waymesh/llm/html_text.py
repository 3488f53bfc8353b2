"""Main text of web pages by consensus paths of hosts.

A page's containers are scored by how much of its running text they hold and how little else. The
best container's path (tags and classes from the body down, numbers generalised) is the page's vote;
Spark adds the votes of each host, and each page is then extracted at its host's winning path, or at
its own best container where it has no such path."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Text and the tag after it, in which quotes count only after an equals sign; it never goes back over what it has read.
PIECE = re.compile(r"""([^<]*+)<(/?[a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Fixed values of HTML: elements without content, with raw content, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Those whose start ends an open one of the same group, up to the element that bounds it.
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements, roles and words in class or id that are not part of an article.
OUTSIDE = frozenset("nav aside footer header form script style noscript template iframe object embed svg canvas button select option textarea input dialog menu head title noembed noframes xmp audio video search".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments commentlist respond replies disqus sidebar aside footer header masthead nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social related recommended recommendations popup modal overlay widget pagination pager toolbar skip search form".split()
)
#: Words that only say what part of a page's layout something is. A name of these and of words outside an article decides by itself;
#: one with other words as well (related-work, notice-of-termination) may be the article's own, and what it holds decides.
STRUCTURAL = frozenset(
    "area author avatar bar block body bottom box bubble button buttons card cards center close col column container content count date fixed float footer group grid header heading icon icons id image img info inline inner input item items js label layout left line link links list main menu message messages meta middle modal more msg name number outer page pages panel parent placeholder post posts reply right row section sections side site slot sticky stories story text time title top unit user wrap wrapper wrapping zone article articles latest popular reader trending also like may more you your".split()
)
#: Of the words outside, those that articles use as well: what bears them is kept if it holds running text and no controls.
UNSURE_WORDS = frozenset("alert form overlay promotion search sharing skip social widget".split())
CONTROLS = frozenset("button form input option select textarea".split())
INSIDE = frozenset("article content main post story entry text body".split())
RUNNING = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dd td figcaption".split())
CONTAINERS = frozenset("html body article main section div td blockquote center".split())
#: Characters from which text that stands bare in a container counts as running, as do sentences of any length; and the share of links from which text does not.
BARE, LINKED = 80, 0.5
SENTENCE = re.compile(r"""[.!?…。！？]["'”’»)\]]*\s*\Z""")
SALTS = 32


RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class _Node:
    __slots__ = ("all", "controls", "hinted", "holds", "links", "n_links", "out", "parent", "path", "running", "semantic", "strong", "tag")

    def __init__(self, tag: str, parent: int, path: int, out: bool, semantic: bool) -> None:
        self.tag, self.parent, self.path, self.out, self.semantic = tag, parent, path, out, semantic
        self.all = self.running = self.links = self.n_links = 0
        self.holds, self.hinted, self.strong, self.controls = False, False, False, tag in CONTROLS


@lru_cache(4096)
def _classes(names: str) -> str:
    return "".join(f".{c}" for c in sorted({re.sub(r"\d+", "#", c.replace(">", "_")) for c in names.split()}))


@lru_cache(4096)
def _words(*names: str) -> frozenset[str]:
    return frozenset(w.lower() for x in names for w in WORD.findall(x))


@lru_cache(4096)
def _strong(*names: str) -> bool:
    """Whether one of the names is of words outside an article, and of none that says what it is about."""
    for name in " ".join(names).split():
        words = {w.lower() for w in WORD.findall(name)}
        if words & (OUTSIDE_WORDS - UNSURE_WORDS) and words <= OUTSIDE_WORDS | STRUCTURAL:
            return True
    return False


class Page:
    """The elements of a page, and its text pieces in order, each with its element; None marks a block's edge.

    The time is proportional to the page's length: tags are read forwards, the places of open
    elements are kept by name, paths are numbers of (path above, step), and totals of elements are
    added up once, from the last to the first."""

    def __init__(self, html: str) -> None:
        self.nodes, self.pieces = [_Node("html", -1, 0, False, False)], []
        self._steps: list[tuple[int, str]] = [(-1, "")]
        self._paths = {(-1, ""): 0}
        self._open, self._places = [0], {"html": [0]}
        self._read(html)
        self._measure()

    def _read(self, html: str) -> None:
        at, quoted = 0, True
        while at < len(html):
            if quoted and (piece := PIECE.match(html, at)):
                text, name, rest = piece.groups()
                self._text(text)
                at = piece.end()
            else:
                begin = html.find("<", at)
                if begin < 0:
                    break
                if html.startswith("<!--", begin):
                    self._text(html[at:begin])
                    end = html.find("-->", begin + 4)
                    at = end + 3 if end >= 0 else len(html)
                    continue
                if html.startswith("<![CDATA[", begin):
                    self._text(html[at:begin])
                    end = html.find("]]>", begin)
                    end = len(html) if end < 0 else end
                    self._text(html[begin + 9 : end], plain=True)
                    at = end + 3
                    continue
                found = NAME.match(html, begin + 1)
                if not found and not html.startswith(("<!", "<?"), begin):
                    self._text(html[at : begin + 1])
                    at = begin + 1
                    continue
                # A tag without an end where quotes count: they count no more, from here on.
                quoted = quoted and not found
                after = found.end() if found else begin
                end = html.find(">", after)
                if end < 0:
                    break  # no tag ends after this place: the rest is text
                self._text(html[at:begin])
                at = end + 1
                if not found:
                    continue
                name, rest = found[0], html[after:end]
            if name[0] == "/":
                self._end(name[1:].lower())
            else:
                at = self._element(html, name.lower(), rest, at)
        self._text(html[at:])

    def _element(self, html: str, name: str, attributes: str, at: int) -> int:
        self._start(name, attributes)
        if name in RAW:
            end = RAW_END[name].search(html, at)
            stop = end.start() if end else len(html)
            self._text(html[at:stop], plain=True)
            self._end(name)
            return stop
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            self._end(name)
        return at

    def _text(self, text: str, plain: bool = False) -> None:
        if text:
            self.pieces.append((self._open[-1], text if plain else unescape(text)))

    def _start(self, name: str, rest: str) -> None:
        if name in ("html", "body") and self._places.get(name):
            return
        if name in BLOCK:
            if name != "br" and self._places.get("p"):
                self._close({"p"}, {"table", "td", "th", "button", "object", "caption"})
            self.pieces.append((self._open[-1], None))
        if name in SIBLING:
            self._close(*SIBLING[name])
        parent, out, semantic, words, classes = self._open[-1], name in OUTSIDE, name in ("article", "main"), frozenset(), ""
        if rest and not rest.isspace():
            attributes: dict[str, str] = {}
            for m in ATTRIBUTE.finditer(rest):
                attributes.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
            classes = _classes(attributes.get("class", ""))
            words = _words(attributes.get("class", ""), attributes.get("id", ""))
            hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            out = out or attributes.get("role", "").lower() in OUTSIDE_ROLES or hidden
            semantic = semantic or "articlebody" in attributes.get("itemprop", "").lower() or name != "body" and bool(words & INSIDE)
        step = (-1, "body") if name == "body" else (self.nodes[parent].path, f"{name}{classes}")
        if (path := self._paths.get(step)) is None:
            path = self._paths[step] = len(self._steps)
            self._steps.append(step)
        self.nodes.append(_Node(name, parent, path, out, semantic))
        if name not in ("html", "body", "article", "main"):
            self.nodes[-1].hinted = bool(words & OUTSIDE_WORDS)
            self.nodes[-1].strong = bool(words) and _strong(attributes.get("class", ""), attributes.get("id", ""))
        if name in ("article", "main", "h1"):
            i = parent
            while i >= 0 and not self.nodes[i].holds:
                self.nodes[i].holds = True
                i = self.nodes[i].parent
        self._places.setdefault(name, []).append(len(self._open))
        self._open.append(len(self.nodes) - 1)

    def _last(self, names: set[str]) -> int:
        """The place of the innermost open element of these names; -1 if there is none."""
        return max((places[-1] for n in names if (places := self._places.get(n))), default=-1)

    def _cut(self, k: int) -> None:
        for i in self._open[k:]:
            self._places[self.nodes[i].tag].pop()
        del self._open[k:]

    def _close(self, names: set[str], bounds: set[str]) -> None:
        k = self._last(names)
        if k > self._last(bounds):
            self.pieces.append((self._open[k], None))
            self._cut(k)

    def _end(self, name: str) -> None:
        if (places := self._places.get(name)) and (k := places[-1]) > 0:
            if name in BLOCK:
                self.pieces.append((self._open[k], None))
            if name not in ("html", "body"):
                self._cut(k)

    def _summed(self) -> None:
        """Adds what elements have to those around them."""
        for i in range(len(self.nodes) - 1, 0, -1):
            n, up = self.nodes[i], self.nodes[self.nodes[i].parent]
            up.all += n.all
            up.running += n.running
            up.links += n.links
            up.n_links += n.n_links + (n.tag == "a")
            up.controls = up.controls or n.controls

    def _measure(self) -> None:
        nodes = self.nodes
        block_of, in_link, running = [0] * len(nodes), [False] * len(nodes), [False] * len(nodes)
        for i, n in enumerate(nodes):
            up = n.parent
            block_of[i] = i if n.tag in BLOCK or i == 0 else block_of[up]
            in_link[i] = n.tag == "a" or i > 0 and in_link[up]
            running[i] = n.tag in RUNNING or n.tag not in CONTAINERS - {"td"} and i > 0 and running[up]
        run: list[tuple[int, int, int, str]] = []

        def add() -> None:
            size, linked = sum(r[1] for r in run), sum(r[2] for r in run)
            if size:
                n = nodes[run[0][0]]
                said = next(r[3] for r in reversed(run) if r[1])
                good = linked < LINKED * size and (running[run[0][0]] or size >= BARE or bool(SENTENCE.search(said[-40:])))
                n.all += size
                n.links += linked
                n.running += size * good
            run.clear()

        for i, text in self.pieces:
            if text is None:
                add()
            elif nodes[i].tag not in RAW and nodes[i].tag != "head":
                size = len("".join(text.split()))
                run.append((block_of[i], size, size * in_link[i], text))
        add()
        own = [n.running for n in nodes]
        self._summed()
        for i, n in enumerate(nodes[1:], 1):
            if n.hinted and not n.holds:
                n.out = n.out or n.strong or not (n.running and not n.controls and n.links < LINKED * n.all)
            menu = n.tag in ("ul", "ol") and n.n_links >= 3 and n.all > 0 and n.links >= 0.9 * n.all  # a list of nothing but links
            n.out = n.out or menu or nodes[n.parent].out
        for n, own_running in zip(nodes, own, strict=True):
            n.running = 0 if n.out else own_running
        for i in range(len(nodes) - 1, 0, -1):
            nodes[nodes[i].parent].running += nodes[i].running

    def path(self, number: int) -> str:
        """Tags and classes from the body down."""
        steps = []
        while number >= 0:
            number, step = self._steps[number]
            steps.append(step)
        return ">".join(reversed(steps))

    def _number(self, path: str) -> int | None:
        number = -1
        for step in path.split(">"):
            if (number := self._paths.get((number, step))) is None:
                return None
        return number

    def best(self) -> tuple[str, float] | None:
        """Path and score (0 to 1.25) of the best container; of equals the innermost. None without running text."""
        total, found = self.nodes[0].running, None
        for n in self.nodes:
            if total and n.running and not n.out and (n.tag in CONTAINERS or n.semantic and n.tag in BLOCK and n.tag not in RUNNING):
                recall, clean = n.running / total, n.running / max(n.all, 1)
                score = 2 * recall * clean / (recall + clean) * (1.25 if n.semantic else 1)
                if found is None or score >= found[1]:
                    found = (n.path, score)
        return found and (self.path(found[0]), found[1])

    def text(self, path: str | None) -> str | None:
        """The article text of all elements at a path, or of the whole page; None if there is no such element with text."""
        number = None if path is None else self._number(path)
        if path is not None and number is None:
            return None
        chosen = [False] * len(self.nodes)
        for i, n in enumerate(self.nodes):
            chosen[i] = n.path == number if path is not None else i == 0
            chosen[i] = (chosen[i] or i > 0 and chosen[n.parent]) and not n.out
        parts: list[str] = []
        for i, text in self.pieces:
            if text is None:
                parts.append(" ")
            elif chosen[i]:
                parts.append(text)
        found = " ".join("".join(parts).split())
        return found or None


def extracted(html: str, path: str | None) -> str:
    """The text at a path, or else at the page's own best container, or else, without running text, of all that is not beside the article."""
    page = Page(html)
    if path is not None and (found := page.text(path)):
        return found
    own = page.best()
    return page.text(own and own[0]) or ""


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = [Page(html).best() or (None, None) for html in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())], ["host", "path", "score"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extracted(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def consensus_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the highest sum of scores among each host's pages; of equals the first."""
    rows = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    votes = rows.mapInArrow(_votes, "host string, path string, score double").where("path IS NOT NULL")
    sums = votes.groupBy("host", "path").agg(F.round(F.sum("score"), 6).alias("score"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), F.col("path"))).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars (code points).

    Null html is empty and gives an empty text. Pages without a host share one vote. Repeated rows
    and null ids stay; an empty table gives no rows; other columns are not read."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    # The paths, a row a host, are written, so that Spark knows their size: few are broadcast and pages stay where they are.
    # Otherwise pages of one host go to SALTS tasks, which adaptive execution splits further, and the host's path to each.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int"))
    paths = written(consensus_paths(pages), "paths").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(paths, ["host", "salt"], "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
