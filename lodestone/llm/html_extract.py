"""HTML extraction with a site style tree.

The pages of a host are merged into one tree of element nodes, named by their path of block elements with
class and id. Presentation: how the pages vary in the sequence of children under a node. Content: how
they vary in the text under it. Both are entropies to the base of the number of pages; what is the same
on all pages has importance 0, what is different everywhere 1. In each page, importances are combined
bottom-up (a node's own presentation counts the more the more children it has), and branches below
``LOW`` are removed. Elements whose tag, role or class says that they are no article text (menus,
headers, footers, side bars, notices, adverts, forms, comments) go whatever their importance, which also serves hosts
with too few pages to compare. If a page has article or main elements, its text is what remains in them.

Tasks parse pages and count; Spark adds the counts up per host and node. Only nodes of low importance
return to the pages, so what a host sends is the size of its repeated template.

Defined results: null or empty html gives an empty text; a null url or one without a host is not compared
with others; repeated rows count and are extracted row by row. Removal by importance is undone within a page if it would
take more than half of the text, as on hosts that serve copies of one article. A line break element is white space.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW = 0.25
LEAST_PAGES = 4
DAMP = 0.9

RAW = "script|style|textarea|title|iframe|noscript|noframes|noembed|xmp|template|svg|math"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[a-z]+")

BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th"
    " caption blockquote pre figure figcaption hr address details summary fieldset legend center"
    " nav header footer aside form menu dialog head hgroup search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes first, looking no further up than the tags after the bar.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NOISE_TAGS = frozenset(
    "head nav footer aside form menu dialog button select datalist input label search audio video canvas object map".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social"
    " sidebar side widget widgets related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation"
    " pagination pager footer masthead comment comments commentlist disqus reply replies respond discussion toolbar skip"
    " hidden copyright disclaimer teaser outbrain taboola".split()
)


def key_of(*parts: object) -> int:
    h = xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)))
    return h - (1 << 64) if h >> 63 else h


class Page:
    """Element nodes and text blocks of one page."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = [""]
        self.key: list[int] = [0]
        self.noise: list[bool] = [False]
        self.names: list[bool] = [False]
        self.children: list[list[int]] = [[]]
        self.blocks: list[tuple[int, str]] = []
        self._stack: list[tuple[str, int]] = [("", 0)]
        self._text: list[str] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._text.append(source[at : m.start()])
            at = m.end()
            if m[3] or m[6]:
                name, closing = (m[3] or m[6]).lower(), m[2] or m[5]
                if closing:
                    self._close(name)
                else:
                    self._open(name, m[4] or m[7] or "")
            # Comments, declarations and raw elements separate nothing.
        if at < len(source) and not source.startswith("<", at):
            self._text.append(source[at:])
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._stack[-1][1], text))
            self._text = []

    def _open(self, name: str, rest: str) -> None:
        if name == "br":
            self._text.append(" ")
            return
        if name in BLOCK:
            self._flush()
            self._imply(name)
        elif name in CLOSES:
            self._imply(name)
        found = {}
        if rest:
            found = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(rest)}
        own = name in NOISE_TAGS
        named = self._named(found) if found else False
        if name in BLOCK or own or named:
            self._flush_before_noise(own or named)
            node = self._node(name, found, own, named)
        else:
            node = self._stack[-1][1]
        if name not in VOID:
            self._stack.append((name, node))

    def _flush_before_noise(self, noise: bool) -> None:
        if noise:
            self._flush()

    @staticmethod
    def _named(found: dict[str, str]) -> bool:
        if "hidden" in found or found.get("aria-hidden") == "true":
            return True
        if found.get("role", "").lower() in NOISE_ROLES:
            return True
        if "none" in found.get("style", "") and re.search(r"display\s*:\s*none", found["style"]):
            return True
        words = NAME_PART.findall(f"{found.get('class', '')} {found.get('id', '')}".lower())
        return not NOISE_NAMES.isdisjoint(words)

    def _node(self, name: str, found: dict[str, str], own: bool, named: bool) -> int:
        up = self._stack[-1][1]
        label = " ".join(NAME_PART.findall(f"{found.get('class', '')}#{found.get('id', '')}".lower()))
        node = len(self.parent)
        self.parent.append(up)
        self.tag.append("main" if found.get("role", "").lower() == "main" else name)
        self.key.append(key_of(self.key[up], name, label))
        self.noise.append(own)
        self.names.append(named)
        self.children.append([])
        self.children[up].append(node)
        return node

    def _imply(self, name: str) -> None:
        """Close what this start tag ends."""
        if name in CLOSES:
            ends, stops = CLOSES[name]
        else:
            ends, stops = {"p"}, {"button", "table", "td", "th"}
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[i][0]
            if tag in ends:
                self._flush()
                del self._stack[i:]
                if name not in ("tr", "dt", "dd"):
                    return
            elif tag in stops:
                return

    def _close(self, name: str) -> None:
        if name in BLOCK or name in NOISE_TAGS:
            self._flush()
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == name:
                if self._stack[i][1] != self._stack[i - 1][1]:
                    self._flush()
                del self._stack[i:]
                return
            if self._stack[i][0] in BLOCK and name not in BLOCK:
                return  # an inline end tag doesn't close blocks

    def statistics(self) -> Iterator[tuple[int, int, int]]:
        """(node, kind, feature), once a page: kind 0 the sequence of children, kind 1 a text of the node."""
        seen = set()
        for key, kids in zip(self.key[1:], self.children[1:]):
            run = []
            for k in kids:
                if not run or run[-1] != self.key[k]:
                    run.append(self.key[k])
            seen.add((key, 0, key_of(*run)))
        for node, text in self.blocks:
            seen.add((self.key[node], 1, key_of(text)))
        return iter(seen)

    def removed(self, low: dict[int, tuple[float, float]]) -> list[bool]:
        """Nodes whose combined importance is low."""
        n = len(self.parent)
        texts: list[bool] = [False] * n
        for node, _ in self.blocks:
            texts[node] = True
        combined = [1.0] * n
        for i in range(n - 1, -1, -1):
            look, text = low.get(self.key[i], (1.0, 1.0))
            parts = [combined[c] for c in self.children[i]]
            if texts[i]:
                parts.append(text)
            if parts:
                damp = DAMP ** len(parts)
                combined[i] = (1 - damp) * look + damp * sum(parts) / len(parts)
                if len(parts) == 1 or texts[i] and not self.children[i]:
                    combined[i] = parts[0]
                # A branch is worth no less than its best part.
                combined[i] = max(combined[i], max(parts) if max(parts) >= LOW else 0.0)
            else:
                combined[i] = look
        return [c < LOW for c in combined]

    def text(self, low: dict[int, tuple[float, float]]) -> str:
        """Main text: the blocks that stay, one a line."""
        n = len(self.parent)
        holds = [t in ("article", "main", "body", "html") for t in self.tag]
        for i in range(n - 1, 0, -1):
            if holds[i]:
                holds[self.parent[i]] = True
        noisy, scope, weak = [False] * n, [""] * n, [False] * n
        gone = self.removed(low) if low else [False] * n
        for i in range(1, n):
            up = self.parent[i]
            scope[i] = self.tag[i] if self.tag[i] in ("article", "main") and scope[up] != "article" else scope[up]
            page_header = self.tag[i] == "header" and scope[i] == ""
            noisy[i] = noisy[up] or self.noise[i] or page_header or (self.names[i] and not holds[i]) or (
                self.names[i] and self.tag[i] in ("article",) and scope[up] in ("article", "main")
            )
            weak[i] = weak[up] or gone[i]
        clear = [(node, t) for node, t in self.blocks if not noisy[node]]
        scopes = {scope[node] for node, _ in clear}
        for wanted in ("article", "main"):
            if wanted in scopes:
                clear = [(node, t) for node, t in clear if scope[node] == wanted]
                break
        kept = [t for node, t in clear if not weak[node]]
        if 2 * sum(map(len, kept)) < sum(len(t) for _, t in clear):
            kept = [t for _, t in clear]
        return "\n".join(kept)




def host_column(url: str):
    """Lower-case host of an absolute address; null where there is none."""
    found = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def style_tree(pages: DataFrame, url: str, source: str) -> DataFrame:
    """(host, node, pages, look, text): importances of presentation and content of every element node of a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for host, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.update((host, *x) for x in Page(value.as_py() or "").statistics())
            cols = list(zip(*counts)) if counts else [(), (), (), ()]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array(list(counts.values()), pa.int64())],
                ["host", "node", "kind", "feature", "n"],
            )

    slim = pages.select(host_column(url).alias("host"), F.col(source).alias("t")).filter("host is not null")
    counted = (
        slim.mapInArrow(run, "host string, node bigint, kind int, feature bigint, n bigint")
        .groupBy("host", "node", "kind", "feature")
        .agg(F.sum("n").alias("n"))
    )
    look, text = F.col("kind") == 0, F.col("kind") == 1
    sums = counted.groupBy("host", "node").agg(
        F.sum(F.when(look, F.col("n")).otherwise(0)).alias("pages"),
        F.sum(F.when(look, F.col("n") * F.log("n")).otherwise(0.0)).alias("spread"),
        F.sum(text.cast("long")).alias("texts"),
        F.sum(F.when(text, F.log("n")).otherwise(0.0)).alias("shared"),
    )
    base = F.log("pages")
    return sums.filter(F.col("pages") >= 2).select(
        "host",
        "node",
        "pages",
        (1 - F.col("spread") / F.col("pages") / base).alias("look"),
        F.when(F.col("texts") > 0, 1 - F.col("shared") / F.col("texts") / base).otherwise(1.0).alias("text"),
    )


def extract(
    pages: DataFrame, url: str = "url", source: str = "html", keep: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """Columns ``keep`` and the main text of every row."""
    low = (
        style_tree(pages, url, source)
        .filter((F.col("pages") >= LEAST_PAGES) & ((F.col("look") < LOW) | (F.col("text") < LOW)))
        .groupBy("host")
        .agg(F.collect_list(F.struct("node", "look", "text")).alias("low"))
    )
    rows = pages.select(*keep, host_column(url).alias("_host"), F.col(source).alias("_html"))
    met = rows.join(low.withColumnRenamed("host", "_host"), "_host", "left").select(*keep, "_html", "low")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, nodes in zip(batch.column(width), batch.column(width + 1)):
                listed = {x["node"]: (x["look"], x["text"]) for x in nodes.as_py() or []}
                texts.append(Page(value.as_py() or "").text(listed))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(width)), pa.array(texts, pa.string())], [*keep, "text"]
            )

    return met.mapInArrow(run, f"{kept}, text string")
