"""Main-text extraction from web pages by consensus of a host's pages.

1. Each page's containers are scored by the running text below them (text in
   links counts against them, text further down counts less), and the best one
   votes for its *generalised path*: tags and classes from the root, digits in
   class names replaced by ``#``.
2. Spark sums the votes per host; the path with most votes wins the host.
3. Each page is read again with its host's path. All containers on that path
   give the text; a page without one, or where together they hold only a small
   share of the page's own best container, falls back to its own best. What
   stands beside a chosen container inside one article or main stays too.

The parser is a single pass over tags: comments, scripts and styles are
skipped as raw text, embedded objects as elements if they are closed,
paragraphs close implicitly, unclosed and truncated markup is fine at any
depth. Boilerplate (navigation, footers, sidebars, adverts, forms, notices,
reader comments) is recognised by tag, role, and class names and ids that say
nothing else, and left out below the chosen container as well.

Votes are summed inside each task, then by (host, path), so a host with a
third of all pages is one small sum. Winners are broadcast up to
``BROADCAST_HOSTS`` hosts; beyond that they are looked up by a join that
spreads heavy hosts.

Defined cases: null or text-free html gives the empty text; a null or
malformed url belongs to the host ''; ties of votes go to the path that sorts
first; repeated rows are extracted alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lookup, materialize, raw_texts, slices, table

BROADCAST_HOSTS = 20_000
#: What one level further down is worth in a container's score.
DECAY = 0.6
#: Containers on the winning path must together hold this share of the best's score.
SHARE = 0.3
#: A container whose share of a block is less gets none; in characters.
LEAST = 1e-9

ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
#: Comments; raw text, which ends at its own end tag or with the page; elements
#: that are skipped whole if they are closed before the next of their kind
#: begins; tags; other markup.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|textarea|title|xmp)\b{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(noscript|template|iframe|object|select|canvas|audio|video|svg)\b{ATTRIBUTES}(?<!/)>(?:(?!<\2\b).)*?</\2\s*>"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({ATTRIBUTES}>|[^>]*>?)"
    r"|<[!?/][^>]*>?",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr noscript template iframe object select canvas audio video svg".split())
CONTAINERS = frozenset("html body main article section div td center table tbody tr blockquote".split())
BLOCKS = CONTAINERS | frozenset(
    "address aside details dialog dd dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr li menu nav ol p pre summary tfoot th thead ul caption button label".split()
)
#: Opening one of these closes an open paragraph.
CLOSES_P = BLOCKS - {"td", "tr", "th", "tbody", "html", "body", "button", "label"}
#: Opening one of these closes an open one of the same kind.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("ul ol dl table tbody thead article section div body".split())

BOILER_TAGS = frozenset("nav footer aside form button dialog menu label fieldset head".split())
BOILER_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
#: A class or id means boilerplate if all its parts are words of these two
#: lists, one of the first at least: "cookie-banner" does, "social-science" not.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars aside rail menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead topbar header comment comments commentlist disqus replies reply respond cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts toast popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend recommended "
    "recommendations trending popular widget widgets toolbar pagination pager skip search taglist bio outbrain taboola form".split()
)
NEUTRAL_WORDS = frozenset(
    "site page main top bottom left right side box bar list lists block wrapper wrap container section sections area item items post posts article articles story stories button "
    "buttons link links slot unit global primary secondary mobile desktop sticky fixed inner outer content body row col column group panel region first last new user author "
    "tag tags reader thread media icon icons mini small large big in the and of by a us you may also like more read next prev previous field input submit email count id".split()
)
#: A header alone is boilerplate only as the site's or the page's.
HEADERS = frozenset({"site-header", "page-header", "main-header", "global-header", "top-header", "header-bar", "header-nav"})
PART = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|\d+")
DIGITS = re.compile(r"\d+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@lru_cache(maxsize=20_000)
def _means_boiler(name: str) -> bool:
    parts = [x.lower() for x in PART.split(name) if x]
    if "header" in parts:
        return "-".join(parts) in HEADERS
    return any(x in BOILER_WORDS for x in parts) and all(x in BOILER_WORDS or x in NEUTRAL_WORDS for x in parts)


def path_key(path: str | None) -> int:
    """The key that a container on a path has."""
    key = 0
    for step in (path or "").split("/")[1:]:
        key = xxhash.xxh64_intdigest(step, key)
    return key


class _Node:
    __slots__ = ("tag", "parent", "step", "key", "boiler", "inside", "link")

    def __init__(self, tag: str, parent: "_Node | None", attributes: str, by_name: bool = True):
        self.tag, self.parent = tag, parent
        self.boiler = bool(parent and parent.boiler)
        self.inside = bool(parent and parent.inside) or tag in ("article", "main")
        self.link = tag == "a" or bool(parent and parent.link)
        names: list[str] = []
        if attributes and "=" in attributes or "hidden" in attributes:
            for key, value in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id"):
                    if by_name and tag not in ("html", "body", "main") and any(map(_means_boiler, value.split())):
                        self.boiler = True
                    if key == "class":
                        names = sorted(DIGITS.sub("#", x.replace("/", "|")) for x in value.split())
                elif (key == "role" and value.lower() in BOILER_ROLES and tag != "main") or key == "hidden":
                    self.boiler = True
                elif (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                    self.boiler = True
        if tag in BOILER_TAGS or (tag == "header" and not self.inside):
            self.boiler = True
        self.step, self.key = None, parent.key if parent else 0
        if tag in CONTAINERS:
            self.step = ".".join([tag, *names])
            self.key = xxhash.xxh64_intdigest(self.step, self.key)

    @property
    def path(self) -> str:
        """Generalised path: the containers from the root."""
        steps = [n.step for n in self.ancestors() if n.step is not None]
        return "/" + "/".join(reversed(steps))

    def ancestors(self):
        node = self
        while node is not None:
            yield node
            node = node.parent


def parse(html: str) -> list[tuple[_Node, str, int]]:
    """Blocks in page order: (innermost block element, text, link characters)
    without boilerplate. A page whose class names and ids would leave nothing
    is read by its tags and roles alone."""
    return _parse(html, True) or _parse(html, False)


def _parse(html: str, by_name: bool) -> list[tuple[_Node, str, int]]:
    root = _Node("html", None, "")
    node, blocks = root, []
    pending: list[str] = []
    links = 0
    owner = root

    def flush() -> None:
        nonlocal links
        if pending:
            text = " ".join(unescape("".join(pending)).split())
            if text and not owner.boiler:
                blocks.append((owner, text, links))
            pending.clear()
        links = 0

    def holder(n: _Node) -> _Node:
        while n.parent is not None and n.tag not in BLOCKS:
            n = n.parent
        return n

    def text(piece: str) -> None:
        nonlocal links, owner
        if not pending:
            if not piece.strip():
                return
            owner = holder(node)
        if not node.boiler or node is owner:
            pending.append(piece)
            if node.link:
                links += len(piece)

    at = 0
    for m in TAG.finditer(html):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = m.group(4)
        if not name:
            continue
        tag = name.lower()
        if m.group(3):  # an end tag
            if tag in BLOCKS:
                flush()
            for up in node.ancestors():
                if up.tag == tag and up.parent is not None:
                    node = up.parent
                    break
                if up.tag in FENCES and tag not in BLOCKS:
                    break
            if tag == "p" and pending:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and pending:
                pending.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if tag == "html":
            continue
        if tag in CLOSES_P:
            for up in node.ancestors():
                if up.tag == "p":
                    node = up.parent
                    break
                if up.tag in FENCES:
                    break
        for up in node.ancestors() if tag in SIBLINGS else ():
            if up.tag in SIBLINGS[tag]:
                node = up.parent
                if tag != "tr" or up.tag == "tr":
                    break
            elif up.tag in FENCES and not (tag == "tr" and up.tag in ("td", "th")):
                break
        if tag == "head":
            node = _Node(tag, root, "")
        elif tag == "body":
            node = _Node(tag, root, m.group(5), by_name)
        elif not m.group(5).endswith("/>") or tag in BLOCKS:
            node = _Node(tag, node, m.group(5), by_name)
    if at < len(html):
        text(html[at:])
    flush()
    return blocks


def containers(blocks) -> dict[_Node, float]:
    """Score of every container above a block."""
    out: dict[_Node, float] = {}
    for owner, text, links in blocks:
        worth = max(0, len(text) - 2 * links) * (0.3 if owner.tag in ("li", "td", "th") and links else 1.0)
        for up in owner.ancestors():
            if up.tag in CONTAINERS:
                out[up] = out.get(up, 0.0) + worth * (1.3 if up.tag in ("article", "main") else 1.0)
                worth *= DECAY
                if worth < LEAST and up in out:
                    break
    return out


def _best(scores: dict[_Node, float]) -> _Node | None:
    best = None
    for node, s in scores.items():
        if best is None or s > scores[best] or (s == scores[best] and node.path < best.path):
            best = node
    return best


def vote(html: str) -> str | None:
    """Generalised path of the page's best container."""
    best = _best(containers(parse(html)))
    return best.path if best else None


def extract(html: str, path: str | None) -> str:
    """Text of the containers on ``path``, or of the page's own best."""
    blocks = parse(html)
    scores = containers(blocks)
    best = _best(scores)
    if best is None:
        return ""
    key = path_key(path)
    on_path = {n for n in scores if n.key == key and path}
    chosen = on_path if on_path and sum(scores[n] for n in on_path) >= SHARE * scores[best] else {best}
    chosen = chosen | {n.parent for n in chosen if n.tag not in ("article", "main") and n.parent is not None and n.parent.inside}
    below = dict.fromkeys(chosen, True)

    def kept(owner: _Node) -> bool:
        climbed = []
        while owner is not None and owner not in below:
            climbed.append(owner)
            owner = owner.parent
        answer = owner is not None and below[owner]
        below.update(dict.fromkeys(climbed, answer))
        return answer

    return "\n".join(text for owner, text, _ in blocks if kept(owner))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def winners(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes, pages) of every host."""
    bounded_batches(pages.sparkSession)

    def run(frames):
        seen: Counter = Counter()

        def flush():
            rows = [(h, p, n) for (h, p), n in seen.items()]
            seen.clear()
            columns = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["host", "path", "n"])

        for b in slices(frames, 128):
            for host, raw in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), strict=True):
                seen[host, vote(raw.decode("utf-8", "replace"))] += 1
            if len(seen) > 100_000:
                yield flush()
        yield flush()

    rows = pages.select(host_of(pages[url_col]).alias("host"), pages[html_col].alias("html")).mapInArrow(run, "host string, path string, n long")
    votes = rows.groupBy("host", "path").agg(F.sum("n").alias("n"))
    named = F.when(F.col("path").isNotNull(), F.struct(-F.col("n"), F.col("path")))
    best = votes.groupBy("host").agg(F.min(named).alias("w"), F.sum("n").alias("pages"))
    return best.select("host", F.col("w.path").alias("path"), "pages")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row."""
    bounded_batches(pages.sparkSession)
    won = materialize(winners(pages, url_col, html_col).withColumn("hk", F.xxhash64("host")), "html-winners")
    size = won.agg(F.count(F.lit(1)).alias("hosts"), F.sum("pages").alias("pages")).first()
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"), F.xxhash64(host_of(pages[url_col])).alias("key"))
    if (size["hosts"] or 0) <= BROADCAST_HOSTS:
        paths = won.select("hk", "path").dropDuplicates(["hk"])
        joined = rows.join(F.broadcast(paths), F.col("key") == F.col("hk"), "left")
    else:
        paths = won.groupBy("hk").agg(F.max("path").alias("path"), F.sum("pages").alias("pages")).withColumnRenamed("hk", "key")
        joined = lookup(rows, paths, "key", "pages", size["pages"], F.xxhash64("page_id", "url"))

    def run(frames):
        for b in slices(frames, 128):
            paths = b.column(3).to_pylist()
            texts = [extract(raw.decode("utf-8", "replace"), p) for raw, p in zip(raw_texts(b.column(2)), paths, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "path").mapInArrow(run, "page_id long, url string, text string")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
