"""Main text of web pages by consensus host paths.

1. Each page is parsed leniently; containers are scored by the text of the blocks directly below them (less what is in
   links, half to the next container up), and the best one is raised to the enclosing article, if there is one.
2. Pages vote, by host, for the generalised tag and class path of their best container (digits out of class names); the
   path with most votes wins a host (ties: more text, then the smaller path). Votes are partial sums, so that a host
   with a third of all pages is no hot group.
3. Every page is extracted again with its host's winning path, and with its own best container where it lacks that path.

Dropped, with all they hold: script-like elements, nav, footer, aside, header outside articles, hidden elements, and
elements whose class, id or role says menu, header, footer, sidebar, notice, advert, form or comment. Names are judged word
by word (`suspicion`): one that is about such a thing alone drops its element, unless that holds the page's article or main
elements; one that merely has such a word among others, and a form element, drops its element only if that is mostly links, or
is outside articles and holds neither an article nor half of the page's text. What `no-`, `with-` or `has-` begins says
nothing. References are decoded, white space in a block becomes one space, blocks are trimmed and joined by one line feed in page order.

Defined cases: null or empty html: empty text. Null urls vote as host "". Pages without any block: empty text. Repeated
rows each get a row; an empty table gives an empty table. Text outside any element is body text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm.cluster import in_arrow, ship, store

#: Hosts whose winners may be broadcast; beyond that they are joined by host.
BROADCAST_HOSTS = 20_000

EVENT = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|iframe|textarea|title|xmp|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    # of these a missing end doesn't take the rest of the page, and svg and math can end at once
    r"|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<=/)>|<(noscript|template|object|svg|math|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?</\2\s*>"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:'([^']*)'|"([^"]*)"|([^\s>"']+)))?""", re.I)
SPACE = re.compile(r"\s+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button", "summary", "legend"}
ONE_OF = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}}
DROP_TAGS = {"nav", "footer", "aside", "head", "button", "dialog", "menu", "search", "audio", "video", "canvas", "map"}
STRONG = set(
    "nav navbar navigation menu menus topnav subnav breadcrumb breadcrumbs masthead topbar footer foot sidebar sidebars aside rail ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot dfp sponsor sponsored promo promos promoted cookie cookies consent gdpr newsletter popup modal overlay comment comments commentlist disqus respond replies share sharing social pagination pager skiplink paywall".split()
)
WEAK = set("header banner notice notices alert alerts announcement toolbar widget widgets hidden related recommended recommendations subscribe subscription signup login search feedback form copyright disclaimer".split())
GOOD = set("article articles content main post entry story body text page".split())
COMMENT = set("comment comments commentlist disqus respond replies".split())
#: Words that leave a name about the same thing; words of things that only have it; beginnings that say whether there is one.
PLAIN = set(
    "area aside bar block box body bottom btn button buttons c card center col column component container count desktop div fixed footer global group head heading inner item items js l left level line link links list main mobile o outer panel primary row second secondary section site slot small sticky sub tab tag title tool tools top u ui unit view wp zone left right posts post user users reader readers text entry page article articles".split()
)
FLAGS = {"no", "not", "with", "without", "has", "have", "hide", "enable", "enabled", "disable", "disabled"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@lru_cache(65_536)
def suspicion(name: str) -> tuple[int, bool, bool]:
    """(what a class or an id says: 0 nothing, 1 perhaps, 2 not the article, 3 comments; whether by weak words alone; whether it has a good word)."""
    words = [w.lower() for w in TOKEN.findall(name) if not w.isdigit()]
    own = set(words)
    good = bool(own & GOOD)
    strong, weak = own & (STRONG | COMMENT), own & WEAK
    if not words or words[0] in FLAGS or not (strong or weak):
        return 0, False, good
    if good and words[-1] not in STRONG | COMMENT | WEAK | PLAIN - GOOD:
        return 0, False, good  # such as content-sidebar-wrap
    known = own <= STRONG | COMMENT | WEAK | GOOD | PLAIN
    if own & COMMENT and (known or words[0] in COMMENT):
        return 3, False, good
    return (2 if known else 1), not strong, good


class Page:
    """The blocks of a page, each with its container; containers with their path, parent and tag."""

    __slots__ = ("parent", "path", "tag", "blocks")

    def __init__(self, html: str, by_name: bool = True):
        self.parent, self.path, self.tag = [-1], [""], [""]
        suspects: dict[int, tuple[int, bool]] = {}  # container: suspicion, whether within an article
        self.blocks: list[tuple[int, str, int, int]] = []  # container, text, characters, of them in links
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, node, dropped, within an article
        text: list[str] = []
        linked, links, at = 0, 0, 0

        def flush() -> None:
            nonlocal linked
            if text:
                t = SPACE.sub(" ", "".join(text)).strip()
                if t:
                    self.blocks.append((stack[-1][1], t, len(t), min(len(t), linked)))
                text.clear()
            linked = 0

        for m in EVENT.finditer(html):
            if m.start() > at and not stack[-1][2]:
                t = unescape(html[at : m.start()])
                text.append(t)
                if links:
                    linked += len(t.strip())
            at = m.end()
            name = m.group(4)
            if not name:
                continue
            name = name.lower()
            if m.group(3):
                if name in BLOCK:
                    flush()
                if name == "a":
                    links = 0
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if name not in BLOCK and stack[k][0] in BLOCK:
                        break
                continue
            if name in BLOCK:
                flush()
                if name in CLOSES_P:
                    self._close(stack, {"p"}, BLOCK)
                if name in ONE_OF:
                    self._close(stack, ONE_OF[name], SCOPE.get(name, set()))
            if name == "br":
                if not stack[-1][2]:
                    text.append(" ")
                continue
            if name in VOID:
                continue
            if name == "a":
                links = 1
            if m.group(5).endswith("/") and name not in BLOCK and name != "a":
                continue
            if name not in BLOCK and len(m.group(5)) < 4:
                stack.append((name, stack[-1][1], stack[-1][2], stack[-1][3]))
                continue
            dropped, label, doubt = self._judge(name, m.group(5), stack[-1], by_name)
            node = stack[-1][1]
            if name not in BLOCK:
                dropped = dropped or doubt > 1
            if name in BLOCK:
                self.parent.append(node)
                self.path.append(f"{self.path[node]}>{name}{label}")
                self.tag.append(name)
                node = len(self.tag) - 1
                if doubt:
                    suspects[node] = (doubt, stack[-1][3])
            stack.append((name, node, dropped, stack[-1][3] or name in ("article", "main") or label == ".@main"))
        if at < len(html) and not stack[-1][2]:
            text.append(unescape(html[at:]))
        flush()
        if suspects:
            self._drop(suspects)

    def _drop(self, suspects: dict[int, tuple[int, bool]]) -> None:
        """Take out the blocks of suspected containers that don't prove to hold the article."""
        size, linked = dict.fromkeys(suspects, 0), dict.fromkeys(suspects, 0)
        for node, _, n, inside in self.blocks:
            for above in self.up(node):
                if above in size:
                    size[above] += n
                    linked[above] += inside
        total = sum(n for _, _, n, _ in self.blocks)
        mains = [n for n, t in enumerate(self.tag) if t in ("article", "main") or self.path[n].endswith(".@main")]
        holders = {above for n in mains for above in self.up(n)}
        sure = {n for n, (doubt, _) in suspects.items() if doubt > 1}
        # an article that no suspected container holds shows that those inside such a one are others
        clear = any(not sure.intersection(self.up(n)) for n in mains)
        gone = set()
        for n, (doubt, inside) in suspects.items():
            if doubt == 1:
                drop = 2 * linked[n] >= size[n] if inside else n not in holders and (2 * size[n] <= total or 2 * linked[n] >= size[n])
            else:
                drop = doubt == 3 or clear or n not in holders
            if drop:
                gone.add(n)
        self.blocks = [b for b in self.blocks if not gone.intersection(self.up(b[0]))]

    @staticmethod
    def _close(stack: list, names: set, scope: set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    @staticmethod
    def _judge(name: str, attributes: str, above: tuple, by_name: bool) -> tuple[bool, str, int]:
        """(whether the element is dropped, the label of its path, how far its names make it suspect)."""
        dropped = above[2] or name in DROP_TAGS or (name == "header" and not above[3])
        label, doubt = "", int(by_name and name in ("form", "fieldset"))
        if len(attributes) > 3:
            found = {}
            for m in ATTRIBUTE.finditer(attributes):
                found.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
            role = found.get("role", "").lower()
            names = found.get("class", "").split()
            classes = sorted({re.sub(r"\d+", "", c) for c in names})
            label = "." + ".".join(classes) if classes else ""
            if role == "main":
                label = ".@main"
            if by_name and not dropped and name not in ("html", "body", "main", "article"):
                said = [suspicion(n) for n in (*names, *found.get("id", "").split())]
                good = any(g for *_, g in said)
                for level, weak, _ in said:
                    if not (weak and (good or (name == "header" and above[3]))):
                        doubt = max(doubt, level)
                if role in DROP_ROLES:
                    doubt = max(doubt, 2)
                dropped = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        return dropped, label, doubt

    def up(self, node: int) -> Iterator[int]:
        while node > 0:
            yield node
            node = self.parent[node]

    def best(self) -> int:
        """The container of the article: the best score, raised to an enclosing article or main element."""
        score: dict[int, float] = {}
        for node, _, size, linked in self.blocks:
            worth = size * (1 - linked / size) ** 2
            # paragraphs, headings and items count for what holds them
            holder = self.parent[node] if self.tag[node] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "dd", "dt") else node
            for k, above in enumerate(self.up(holder)):
                if k > 2:
                    break
                score[above] = score.get(above, 0.0) + worth / 2**k
        if not score:
            return 0
        top = max(score, key=lambda n: (score[n], -n))
        for above in self.up(top):
            if self.tag[above] in ("article", "main") or self.path[above].endswith(".@main"):
                return above
        heads = {self.parent[n] for n, *_ in self.blocks if self.tag[n] == "h1"}
        above = self.parent[top]
        return above if above in heads and self.tag[above] not in ("", "html", "body") else top

    def text(self, path: str | None) -> str:
        """The blocks below the containers of the path; below the page's own best container where it has no such path."""
        chosen = {n for n, p in enumerate(self.path) if p == path} if path else set()
        out = [t for n, t, *_ in self.blocks if any(x in chosen for x in self.up(n))] if chosen else []
        if not out:
            own = self.best()
            out = [t for n, t, *_ in self.blocks if own == 0 or own in self.up(n)]
        return "\n".join(out)


def parse(html: str | None) -> Page:
    """A page; where names alone would drop all of its text, without regard to them."""
    page = Page(html or "")
    return page if page.blocks else Page(html or "", by_name=False)


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), "://([^/?#]*)", 1), F.lit("")))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths, sizes = [], []
        for html in b.column("html"):
            page = parse(html.as_py())
            node = page.best()
            paths.append(page.path[node] if node else None)
            sizes.append(sum(s for n, _, s, _ in page.blocks if node in page.up(n)) if node else 0)
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["host", "path", "size"])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes): the winning container path of each host."""
    ship(pages.sparkSession)
    votes = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).transform(in_arrow, _vote, "host string, path string, size long").where("path is not null")
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("size").alias("size"))
    best = sums.groupBy("host").agg(F.min_by(F.struct("path", "votes"), F.struct(-F.col("votes"), -F.col("size"), "path")).alias("w"))
    return best.select("host", "w.path", "w.votes")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each page."""
    spark = pages.sparkSession
    ship(spark)
    winners = store(host_paths(pages, url, html), "host-paths")
    winners = F.broadcast(winners) if winners.count() <= BROADCAST_HOSTS else winners
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"), host_of(url).alias("host")).join(winners, "host", "left").select("key", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [parse(h.as_py()).text(p.as_py()) for h, p in zip(b.column("html"), b.column("path"))]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [key, "url", "text", "n_chars"])

    return rows.transform(in_arrow, run, f"`{key}` {kind}, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
