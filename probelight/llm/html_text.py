"""Main text of web pages by consensus host paths.

Each page scores its containers by the prose they hold, less what is linked; its best one votes with its generalised
path of tags and classes. Votes are counted per host and path in Spark, and every page is extracted again by its
host's winning paths, in their order; a page that has none of them falls back on its own best container.

A container inside an article (or else a main) element stands for that element. Menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts and styles are left out wherever they are; headings inside an article's
header stay, and its paragraphs but for bylines. A label or button amid the words of a paragraph is read. A head ends
where a tag or text stands that it cannot hold; an unclosed noscript, iframe, title or textarea hides no more than the
text up to the next tag. A class or id leaves its part out only if the whole name says so: 'share-buttons' does, 'share-price'
does not; and if such names would leave out the whole page, they are not heeded. Text of formulas stays, drawings go.
Character references are decoded, white space within a block is one space, blocks are lines.

Cases: a null or empty html has no text; a null or odd url belongs to the host ''; unclosed and stray tags are read
as browsers do, roughly; pages of any length are read whole; repeated rows give repeated rows; other columns, also
those named text, n_chars or paths, are ignored; of paths with equal votes and worth the first by name stands first;
an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

# Paths of a host that stand for it, best first. A page that has none of these is read by its own best container.
MOST_PATHS = 1000

# Fixed lists of names.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title head".split())
HIDDEN = frozenset("template svg object canvas video audio map select option datalist".split())
FOREIGN = frozenset("svg math".split())
LEFT_OUT = frozenset("nav footer aside form button menu dialog label fieldset".split())
CONTROLS = frozenset("button label".split())
PROSE = frozenset("p li dd td blockquote h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
BYLINE = frozenset("byline author authors by date dateline meta posted published updated time timestamp credit credits".split())
_BYLINE = re.compile(r"(?:by|posted|published|updated|written|von|par|por|di)\b", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar aside rail masthead topbar toolbar ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond replies reply pagination pager widget search skip tracking".split()
)
# Words that say nothing of what a part is about: a name of marks and these alone marks its part.
PLAIN = frozenset(
    "box list block container wrapper wrap section area button buttons link links bar panel form post posts article articles item items content contents inner outer slot unit top bottom left right header title icon icons widget body group row col column text main site page global js u".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section main div aside nav footer header form blockquote".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Node:
    tag: str
    path: str
    parent: Node | None
    out: bool  # left out, or inside something that is
    article: Node | None = None  # the outermost article, or main, around it
    main: Node | None = None
    headed: bool = False  # inside a heading
    inline: bool = False
    heading_only: bool = False
    lede: bool = False  # a paragraph of an article's header
    score: int = 0
    blocks: list[int] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[str, Node, bool]]  # text, container, heading
    source: str = ""
    marks: bool = True

    def within(self, chosen: list[Node]) -> list[str]:
        """The texts of the blocks under any of the nodes, in page order; every node is looked at once."""
        inside: dict[int, bool] = {id(n): True for n in chosen}
        found = []
        for text, at, _ in self.blocks:
            way, above = [], at
            while above is not None and id(above) not in inside:
                way.append(id(above))
                above = above.parent
            held = above is not None and inside[id(above)]
            inside.update(dict.fromkeys(way, held))
            if held:
                found.append(text)
        return found


def _attributes(source: str) -> tuple[list[str], set[str], str, bool]:
    classes, names, role, hidden = [], set(), "", False
    for name, value in _ATTRIBUTE.findall(source):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            role = value.lower()
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            continue
        else:
            if name == "class":
                classes = value.split()
            names.update(value.split())
    return classes, names, role, hidden


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


def _marked(names: set[str]) -> bool:
    """Whether a class or id, taken whole, says that its part is no article text: 'share-buttons' does, 'share-price' does not."""
    for name in names:
        words = _words(name)
        if any(w in MARKS for w in words) and all(w in MARKS or w in PLAIN for w in words):
            return True
    return False


def _general(tag: str, classes: list[str]) -> str:
    kept = sorted({re.sub(r"\d+", "", c) for c in classes} - {""})
    return ".".join([tag, *kept])


def parse(source: str, marks: bool = True) -> Page:
    """The page's containers and blocks of text; with marks=False names of classes and ids leave nothing out."""
    root = Node("", "", None, False)
    page = Page([root], [], source, marks)
    node, buffer, linked = root, [], 0
    links, head = 0, False

    def flush() -> None:
        nonlocal buffer, linked
        text = " ".join("".join(buffer).split())
        if text:
            at = node
            while at.inline:
                at = at.parent
            if at.lede and _BYLINE.match(text):
                buffer, linked = [], 0
                return
            page.blocks.append((text, at, at.tag in HEADINGS))
            # Prose counts for the block's container, by half for the one above.
            worth = max(0, len(text) - 2 * linked)
            holder = at.parent if at.tag in ("p", "pre", "li", "blockquote", "td", *HEADINGS) and at.parent is not None else at
            holder.score += 2 * worth
            if holder.parent is not None:
                holder.parent.score += worth
        buffer, linked = [], 0

    def text(piece: str) -> None:
        nonlocal linked, head
        if head and piece.strip():
            head = False
        if piece and not node.out and not (node.heading_only and not node.headed and not node.lede):
            piece = unescape(piece) if "&" in piece else piece
            buffer.append(piece)
            if links:
                linked += len(piece.strip())

    def close(to: Node) -> None:
        """Leave all elements down to and with `to`."""
        nonlocal node
        if not to.inline:
            flush()
        node = to.parent

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "head":
                head = False
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCKS or node.inline:
                above: Node | None = node
                while above is not None and above.tag != tag:
                    above = above.parent
                if above is not None and above.parent is not None:
                    close(above)
                elif tag == "p":
                    flush()
            continue
        if tag == "head":
            head = True
            continue
        if head and tag not in IN_HEAD:
            head = False
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            if end is None and tag not in ("script", "style"):  # never closed: it hides its text alone
                following = source.find("<", at)
                at = following if following >= 0 else size
            elif not m[3].endswith("/") or tag in ("script", "style"):
                at = end.end() if end else size
            continue
        if tag == "br":
            text(" ")
            continue
        if tag == "hr":
            flush()
        if tag in VOID:
            continue
        if tag == "a":
            links += 1
        block = tag in BLOCKS
        if block:
            above = node  # drawings and formulas end where a block begins
            while above.inline:
                if above.tag in FOREIGN:
                    node = above.parent
                above = above.parent
            flush()
            links = 0 if tag != "a" else links
            shut = node
            while shut.inline and shut.tag not in HIDDEN:  # what is hidden closes nothing around it
                shut = shut.parent
            if shut.tag == "p" or (shut.tag in HEADINGS and tag in HEADINGS):
                close(shut)
            if tag in CLOSES:
                above = node
                while above is not None and above.tag not in CLOSES[tag] and above.tag not in SCOPES:
                    above = above.parent
                if above is not None and above.tag in CLOSES[tag]:
                    close(above)
        classes, names, role, hidden = _attributes(m[3]) if m[3] else ([], set(), "", False)
        whole = tag in ("html", "body", "article", "main")
        holder = node
        while holder.inline:
            holder = holder.parent
        amid = tag in CONTROLS and holder.tag in PROSE and bool("".join(buffer).strip())
        gone = (tag in LEFT_OUT and not amid) or tag in HIDDEN or hidden or role in ROLES or bool(marks and not whole and names and _marked(names))
        header = tag == "header" or (block and not whole and tag not in HEADINGS and any(_words(n)[-1:] == ["header"] for n in names))
        inside = header and node.article is not None
        if m[3].endswith("/") and tag in FOREIGN:
            continue
        if block:
            path = f"{node.path}/{_general(tag, classes)}" if not node.inline else node.path
            own = Node(tag, path, node, node.out or gone or (header and not inside), node.article, node.main, node.headed or tag in HEADINGS, heading_only=node.heading_only or inside)
            own.lede = node.lede or (tag == "p" and node.heading_only and not any(w in BYLINE for n in names for w in _words(n)))
            own.article = own.article or (own if tag == "article" else None)
            own.main = own.main or (own if tag == "main" else None)
            node = own
            page.nodes.append(node)
        elif gone or tag in FOREIGN or (node.inline and node.tag == tag):
            node = Node(tag, node.path, node, node.out or gone, node.article, node.main, node.headed, inline=True, heading_only=node.heading_only, lede=node.lede)
    flush()
    return page


def best_container(page: Page) -> Node:
    best = max(page.nodes, key=lambda n: n.score)  # the first of equals
    return best.article or best.main or best


def extract(page: Page, paths: list[str] | None) -> str:
    """The text under the first of the paths that has any on this page, or else under the page's best container."""
    by_path: dict[str, list[Node]] = {}
    for n in page.nodes if paths else ():
        if not n.out:
            by_path.setdefault(n.path, []).append(n)
    for path in paths or ():
        chosen = by_path.get(path, [])
        lines = page.within(chosen) if chosen else []
        if lines:
            break
    else:
        chosen = [best_container(page)]
        lines = page.within(chosen)
    if not lines and not page.blocks and page.marks and page.source:
        return extract(parse(page.source, marks=False), paths)  # a name round the whole page left everything out
    titles = [i for i, (_, n, _) in enumerate(page.blocks) if n.tag == "h1"]
    if len(titles) == 1 and lines and page.blocks[titles[0]][0] not in lines:
        first = next(i for i, (t, _, _) in enumerate(page.blocks) if t == lines[0])
        if titles[0] < first:
            lines = [page.blocks[titles[0]][0], *lines]
    return "\n".join(lines)


def host(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1), F.lit(""))


def vote(pages: DataFrame) -> DataFrame:
    """host, paths: the paths of a host by their votes, best first."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, worth = [], []
            for source in batch.column(1).to_pylist():
                page = parse(source) if source else None
                if page is not None and not page.blocks:
                    page = parse(source, marks=False)
                best = best_container(page) if page is not None else None
                paths.append(best.path if best is not None and best.path else None)
                worth.append(best.score if best is not None else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(worth, pa.int64())], ["host", "path", "worth"])

    ballots = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, worth long")
    # Written, since votes are counted once and read twice.
    counted = materialize(ballots.where("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("worth").alias("worth")), "votes")
    best_first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("worth"), "path"))
    top = counted.withColumn("_rank", best_first).where(F.col("_rank") <= MOST_PATHS)
    ranked = F.array_sort(F.collect_list(F.struct("_rank", "path")))
    return top.groupBy("host").agg(ranked.alias("_p")).select("host", F.col("_p.path").alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The winners are a row for each host, written and read back: Spark broadcasts them only when their true size is
    under spark.sql.autoBroadcastJoinThreshold, and otherwise splits a hot host's partition.
    """
    winners = materialize(vote(pages), "paths").withColumnRenamed("host", "_host")
    joined = pages.select("page_id", "url", "html").withColumn("_key", host(F.col("url"))).join(winners, F.col("_key") == F.col("_host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(parse(source), paths) if source else "" for source, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
