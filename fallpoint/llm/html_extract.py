"""Main text of web pages by consensus paths of their hosts.

Every page is parsed once to score its containers, and gives one vote to the generalised
tag-class path of its best one.  Spark adds the votes by host and path; the winning path of a
host then tells on each of its pages which container holds the article.  A page on which that
path does not occur falls back to its own best container.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallpoint.llm.common import prepared, store, text_of

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rt rp rtc s "
                   "samp small span strike strong sub sup time tt u var wbr td th".split())
DROPPED = frozenset("aside button canvas datalist dialog embed footer form head iframe input link map menu meta nav noscript object "
                    "option script select style svg template textarea title".split())
CONTAINERS = frozenset("article body center div fieldset main section table tbody td th".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "body": ("head",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
         "option": ("select",), "tbody": ("table",), "body": ()}
# Words in class, id or role that mark what is not the article, and those that hint at it.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising adslot alert banner breadcrumb breadcrumbs byline-share comment "
                        "commentlist comments complementary consent contentinfo cookie cookies dialog disclaimer discussion disqus footer gdpr login menu "
                        "masthead modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion recommended related "
                        "reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar "
                        "topbar trackback widget".split())
# Words that turn a mark into a statement about the whole (``with-sidebar``), and last words that name a whole page (``social-page``).
STATES = frozenset("enable enabled has hide is no show with without".split())
WHOLES = frozenset("layout main page site".split())
HINTS = frozenset("article body content entry main page post story text".split())

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
                   r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^<>]*+)(?:>|\Z|(?=<))""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|\Z))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NUMBER = re.compile(r"\d+")


class Page:
    """Elements and text blocks of one page, in page order."""

    def __init__(self, html: str):
        self.parent, self.tag, self.hint, self.hard, self.soft = [-1], ["body"], [False], [False], [False]
        self.path, self.own = [""], [0]  # digest of the generalised path; innermost container, itself included
        self.near, self.article, self.shows, self.shade = [0], [False], [0], [False]  # innermost marked element; inside an article; what a marked one holds; inside a marked article
        self.blocks: list[tuple[int, str, int]] = []
        self.read(html)
        self.drop = self.settle()
        self.blocks = [b for b in self.blocks if not self.drop[b[0]]]

    def traits(self, tag: str, attributes: str, parent: int) -> tuple[str, bool, bool, bool]:
        """Generalised name, whether the subtree is dropped, whether it is marked as not the article, whether it hints at one."""
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        classes = found.get("class", "").split()
        name = f"{tag}.{NUMBER.sub('#', classes[0])}" if classes else tag
        words, marked = set(), False
        for token in " ".join(found[k] for k in ("class", "id", "role") if k in found).split():
            said = [w.lower() for w in WORD.findall(token)]
            words.update(said)
            whole = said and (said[0] in STATES or len(said) > 1 and said[-1] in WHOLES)
            marked = marked or not whole and not BOILERPLATE.isdisjoint(said)
        drop = tag in DROPPED and tag != "form" or tag == "header" and not self.article[parent]
        drop = drop or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        return name, drop or self.hard[parent], marked or tag == "form", tag in ("article", "main") or not words.isdisjoint(HINTS)

    def open(self, tag: str, attributes: str, parent: int) -> None:
        """One more element."""
        name, hard, marked, hint = self.traits(tag, attributes, parent)
        exempt = tag in ("html", "body", "article", "main", "h1")
        hard = hard or marked and not exempt and tag in INLINE
        soft = marked and not exempt and not hard
        k = len(self.tag)
        near = k if soft else self.near[parent]
        shade = not soft and (marked or self.shade[parent])
        if near != k and not shade and not hard:
            self.shows[near] = max(self.shows[near], 2 if tag in ("article", "main", "h1") else hint and tag in CONTAINERS)
        self.parent.append(parent)
        self.tag.append(tag)
        self.hint.append(hint)
        self.hard.append(hard)
        self.soft.append(soft)
        self.near.append(near)
        self.shows.append(0)
        self.shade.append(shade)
        self.article.append(self.article[parent] or tag in ("article", "main"))
        self.own.append(k if tag in CONTAINERS else self.own[parent])
        self.path.append(self.path[parent] if tag == "body" else hashlib.blake2b(f"{self.path[parent]}>{name}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest())

    def settle(self) -> list[bool]:
        """Which elements are dropped.  A marked one stays if it is what holds the article: more text outside links, that of marked ones in it
        not counted, than all that stays so far, and an article or main heading; or an element that hints at one where nothing else stays.
        What is marked around it loses its own text only."""
        worth = [0] * len(self.tag)
        for at, text, linked in self.blocks:
            worth[self.near[at]] += max(0, len(text) - linked)
        stays, held = worth[0], [True] * len(self.tag)
        for k in range(1, len(held)):
            if self.soft[k]:
                held[k] = worth[k] > stays and (self.shows[k] == 2 or self.shows[k] == 1 and stays == 0)
                stays += worth[k] if held[k] else 0
        return [hard or not held[near] for hard, near in zip(self.hard, self.near)]

    def read(self, html: str) -> None:
        stack = [0]
        text: list[str] = []
        linked = 0
        depth_a = 0
        at = 0
        low = ""

        def say(data: str) -> None:
            nonlocal linked
            if data and not self.hard[stack[-1]]:
                data = entities.unescape(data) if "&" in data else data
                text.append(data)
                linked += len(data) if depth_a else 0

        def end_block() -> None:
            nonlocal linked
            if text:
                words = " ".join("".join(text).split())
                if words:
                    self.blocks.append((stack[-1], words, linked))
                text.clear()
            linked = 0

        def close(to: int) -> None:
            nonlocal depth_a
            while len(stack) > to:
                depth_a -= self.tag[stack.pop()] == "a"

        while True:
            m = TOKEN.search(html, at)
            say(html[at:m.start()] if m else html[at:])
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                if m[0].startswith("<![CDATA["):
                    say(m[0][9:].removesuffix("]]>"))
                continue
            tag, ending, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            inline = tag in INLINE
            if ending:
                for k in range(len(stack) - 1, 0, -1):
                    open_tag = self.tag[stack[k]]
                    if open_tag == tag:
                        if inline:
                            if tag in ("td", "th"):
                                text.append(" ")
                        else:
                            end_block()
                        close(k)
                        break
                    if inline and open_tag not in INLINE:
                        break
                continue
            if tag == "html":
                continue
            if inline:
                if tag in ("br", "td", "th", "img", "wbr"):
                    text.append("" if tag == "wbr" else " ")
            else:
                end_block()
                for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if self.tag[stack[k]] == "p":
                        close(k)
                        break
                    if self.tag[stack[k]] not in INLINE:
                        break
            if tag in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] in CLOSES[tag]:
                        end_block() if tag not in ("td", "th") else None
                        close(k)
                        break
                    if self.tag[stack[k]] in HOLDS[tag]:
                        break
            if tag in VOID:
                continue
            if tag in RAW:
                low = low or html.lower()
                stop = low.find(f"</{tag}", at) if len(low) == len(html) else -1
                if len(low) != len(html):
                    found = re.compile(f"</{tag}", re.I).search(html, at)
                    stop = found.start() if found else -1
                at = len(html) if stop < 0 else stop
                if stop >= 0:
                    shut = html.find(">", stop)
                    at = len(html) if shut < 0 else shut + 1
                continue
            self.open(tag, attributes, stack[-1])
            stack.append(len(self.tag) - 1)
            depth_a += tag == "a"
        end_block()

    def best(self) -> tuple[int, float]:
        """The container with the highest score: characters outside links of its own blocks, half of those one container
        further in, weighed up where its name hints at an article.  The first one wins a tie."""
        score: dict[int, float] = {}
        for at, text, linked in self.blocks:
            worth = max(0, len(text) - 2 * linked)
            own = self.own[at]
            score[own] = score.get(own, 0.0) + worth
            if own > 0:
                out = self.own[self.parent[own]]
                score[out] = score.get(out, 0.0) + 0.5 * worth
        best, most = 0, 0.0
        for at in sorted(score):
            value = score[at] * (1.5 if self.hint[at] else 1.0)
            if value > most:
                best, most = at, value
        return best, most

    def text(self, path: str | None) -> str:
        """Blocks inside the containers at that path, or inside the page's own best container."""
        roots = {k for k in range(len(self.tag)) if self.tag[k] in CONTAINERS and not self.drop[k] and self.path[k] == path} if path is not None else set()
        lines = self.inside(roots)
        return "\n".join(lines if lines else self.inside({self.best()[0]}))

    def inside(self, roots: set[int]) -> list[str]:
        held = [k in roots for k in range(len(self.tag))]
        for k in range(1, len(held)):
            held[k] = held[k] or held[self.parent[k]]
        return [text for at, text, _ in self.blocks if held[at]]


VOTES = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64())])


def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for host, data in zip(b.column(0).to_pylist(), b.column(1)):
            page = Page(data.as_py())
            at, score = page.best()
            if score > 0:
                rows.append((host, page.path[at], score))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 3, VOTES)], schema=VOTES)


def host_of(url: str | Column) -> Column:
    """Lower-case host of an address without port; empty where there is none."""
    return F.lower(F.regexp_extract(text_of(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def consensus_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path: digest of the container path that most pages of a host vote for; ties go to the higher total score, then to the
    lesser path.  Pages without text do not vote."""
    votes = pages.select(host_of(url_col).alias("host"), text_of(html_col).alias("html")).mapInArrow(vote, "host string, path string, score double")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round("score").cast("long")).alias("score"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), -F.col("score"), "path")).alias("path"))


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and text of every row; text is empty where the html is null or holds none.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left
    out, character references decoded, white space inside a block made one space, blocks joined by one
    line feed.  Pages without a host share one vote.  Repeated rows each give a row; other columns are
    ignored; an empty table gives no rows.  Pages may be of any length and nested to any depth: an element takes a
    fixed time and place, whatever its depth.
    """
    prepared(pages)
    # Written first, so that its size is known: Spark broadcasts it below its threshold and else joins by host.
    paths = store(consensus_paths(pages, url_col, html_col), "host-paths")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        text_of(html_col).alias("html"), host_of(url_col).alias("host"))
    joined = rows.join(paths, "host", "left").select("page_id", "url", "html", "path")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(h.as_py()).text(p) for h, p in zip(b.column(2), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(extract, "page_id long, url string, text string").withColumnsRenamed({"page_id": id_col, "url": url_col})
