"""Main text of web pages by a site style tree (Yi, Liu and Li, 2003).

The DOMs of one host are merged: a style node is a path of elements with their classes. Text stands in leaves alone, so the leaves decide:
a node's importance is the entropy of what the host's pages show there, a text's that it is not on most of them. Pages that show the same
are one page, so that copies of an article do not make it unimportant. What an element says of itself (nav, footer, class "ad", ...) is cut
before. An article or main element is a prior: what is in it stays unless the tree finds it unimportant, what is outside goes unless the
tree finds it important; a page without one is all article.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stage

#: Up to so many rows of overruled nodes or pages, 16 to 24 MB, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*+>")
#: The same where quotation marks say nothing.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>")
#: After so many tags whose quotation marks do not close, those of the page say nothing: each may be sought to the end of the page.
_ODD_QUOTES = 8
_OPENS = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
# Elements of HTML by kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea select svg object canvas title".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_NOISE_TAGS = frozenset("nav footer aside dialog menu button head search".split())
#: Words of a class, id or role that say an element is not the article.
_NOISE_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Of these, words that say so within an article only if the name has no other word than these.
_WEAK_WORDS = frozenset("banner header notice notices promoted recommended related respond social".split())
_WEAK_WITH = frozenset("area articles bar block box buttons container content icons items links list media news pages posts reading section stories topics wrapper".split())
#: Classes that tell of a page's state or layout, such as has-sidebar and comments-open.
_STATE = re.compile(r"(?:has|with|without|no)[-_]|.*[-_](?:open|closed|enabled|disabled)\Z")
_HEADINGS = frozenset("article main section".split())
_CLOSED_BY = {"li": ("li", "ul ol menu".split()), "dd": ("dd dt", ["dl"]), "dt": ("dd dt", ["dl"]), "tr": ("tr td th", ["table"]), "td": ("td th", ["tr", "table"]), "th": ("td th", ["tr", "table"]), "option": ("option", ["select"])}


def _noise(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether the element is noise whatever it holds."""
    return tag in _NOISE_TAGS or tag == "header" and not inside or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _named_noise(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether the element is noise by its names, unless it holds the article. Names of html, body, main and article say nothing."""
    if tag in ("html", "body", "main", "article") or attrs.get("role") == "main":
        return False
    if tag == "form":
        return True
    for name in (x for k in ("class", "id", "role") for x in attrs.get(k, "").lower().split() if not _STATE.match(x)):
        words = set(re.split(r"[^a-z0-9]+", name)) - {""}
        told = words & _NOISE_WORDS - ({"header"} if inside else set())
        if told and (not inside or told - _WEAK_WORDS or words <= _WEAK_WORDS | _WEAK_WITH):
            return True
    return False


class _Open:
    """The open elements, with the places of each tag, of blocks and of headings among them, so that no step walks the whole stack."""

    def __init__(self):
        self.stack: list[tuple] = [("", 0, False, 0, 0)]  # tag, style node, noise, its element named as noise, its article
        self.places: dict[str, list[int]] = {}

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, entry: tuple) -> None:
        for name in _kinds(entry[0]):
            self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(entry)

    def cut(self, to: int) -> None:
        for entry in self.stack[to:]:
            for name in _kinds(entry[0]):
                self.places[name].pop()
        del self.stack[to:]


def _kinds(tag: str) -> list[str]:
    return [tag] + ["*block"] * (tag in _BLOCK) + ["*heading"] * (tag in _HEADINGS)


def blocks(page: str | None) -> list[tuple[int, str, bool, bool]]:
    """(style path, text, within the article, cut by what its elements say) of each block with text, in page order.

    A path is a digest of the elements and classes around the block. What is noise is told of each run of text: an inline advert leaves
    its block, and the block stays. Names (class, id, role, form) cut no element that holds the article, which is the article or main
    element with most text, one of main first; where they would cut all that a page shows, they cut nothing. Tolerant: end tags that match
    nothing are ignored, a block ends an open paragraph, and what is open at the end is closed. Time is linear in the page's length.
    """
    text = page or ""
    tree = _Open()
    out: list[tuple] = []
    articles: list[list] = [[False, 0, 0, 0]]  # within main, text length, element named as noise around it, article around it
    named = [0]  # of each element named as noise the one around it
    held: list[tuple[str, bool, int]] = []

    def say(a: int, b: int) -> None:
        if a < b:
            _, _, noise, name, article = tree.stack[-1]
            held.append((text[a:b], noise, name))
            if article and not noise and name == articles[article][2]:
                articles[article][1] += len(text[a:b].strip())

    def flush() -> None:
        if held:
            out.append((tree.stack[-1][1], bool(tree.stack[-1][4]), held.copy()))
            held.clear()

    at, told, last, pattern, odd = 0, 0, text.rfind(">"), _TAG, 0
    while 0 <= (at := text.find("<", at)) < last:
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            say(told, at)
            at = told = end + 3 if end >= 0 else len(text)
            continue
        m = pattern.match(text, at)
        if not m and pattern is _TAG and _OPENS.match(text, at):
            m, odd = _PLAIN_TAG.match(text, at), odd + 1
            pattern = _PLAIN_TAG if odd > _ODD_QUOTES else _TAG
        if not m:
            at += 1
            continue
        say(told, at)
        at = told = m.end()
        if not m[2]:
            continue
        tag, raw = m[2].lower(), m[3]
        if m[1]:
            k = tree.last(tag)
            if k and (tag in _BLOCK or k >= tree.last("*heading")):
                if tree.last("*block") >= k:
                    flush()
                tree.cut(k)
            elif tag in _BLOCK:
                flush()
            continue
        if tag == "br":
            held.append((" ", *tree.stack[-1][2:4]))
            continue
        if tag in _RAW and not raw.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(text, at)
            at = told = stop.end() if stop else len(text)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _BLOCK:
            flush()
            if (k := tree.last("p")) and k == tree.last("*block"):  # a block ends the paragraph it is in
                tree.cut(k)
            if tag in _CLOSED_BY:
                ended, until = _CLOSED_BY[tag]
                if (k := tree.last(*ended.split())) > tree.last(*until):
                    tree.cut(k)
        if raw.endswith("/") and tag not in _BLOCK:
            continue
        attrs = {a.lower(): _html.unescape(b or c or d) for a, b, c, d in _ATTR.findall(raw)} if "=" in raw or "hidden" in raw.lower() else {}
        _, path, noise, name, article = tree.stack[-1]
        noise = noise or _noise(tag, attrs, bool(article))
        if _named_noise(tag, attrs, bool(article)):
            named.append(name)
            name = len(named) - 1
        main = tag == "main" or attrs.get("role") == "main"
        if main or tag == "article":
            articles.append([main or articles[article][0], 0, name, article])
            article = len(articles) - 1
        if tag in _BLOCK:
            path = _node(f"{path}>{tag}." + "_".join(sorted(attrs.get("class", "").split())))
        tree.push((tag, path, noise, name, article))
    rest = max(told, last + 1)
    cut = _OPENS.search(text, rest)
    say(told, cut.start() if cut else len(text))
    flush()
    for _, size, name, around in reversed(articles[1:]):  # what an inner one shows, the outer shows as well
        if name == articles[around][2]:
            articles[around][1] += size
    allowed = {0}
    if len(articles) > 1:
        name = max(articles[1:], key=lambda x: x[:2])[2]
        while name:
            allowed.add(name)
            name = named[name]
    shown = lambda runs: " ".join(_html.unescape("".join(t for t, noise, name in runs if not noise and name in allowed)).split())
    found = [(path, shown(runs), article, runs) for path, article, runs in out]
    if not any(x[1] for x in found):
        allowed = set(range(len(named)))
        found = [(path, shown(runs), article, runs) for path, article, runs in out]
    every = lambda runs: " ".join(_html.unescape("".join(r[0] for r in runs)).split())
    return [(path, words or every(runs), article, not words) for path, words, article, runs in found if words or every(runs)]


def _host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _node(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


def _keyed(host: str, page: str | None) -> tuple[bool, list[tuple[int, int, str]]]:
    """Whether the page marks its article; (style node of the host, text digest, text) of each block that is not noise.

    An odd node is kept by the prior.
    """
    found = [x for x in blocks(page) if not x[3]]
    marked = any(x[2] for x in found)
    return marked, [(_node(f"{host}\n{path}") & ~1 | (article or not marked), _node(words) or 1, words) for path, words, article, _ in found]


_PARSED = "row bigint, page_id bigint, url string, marked boolean, copy bigint, nodes array<struct<node:bigint,words:bigint,content:bigint>>, blocks array<struct<node:bigint,words:bigint,text:string>>"


def parsed(pages: DataFrame) -> DataFrame:
    """A row a page, parsed once: its blocks, and each style node and text that it shows.

    content digests what the page shows at a node, where words is 0; a text's words is its digest. copy digests the whole page.
    """

    def parse(batches):
        at = TaskContext.get().partitionId() << 40
        long, block = pa.int64(), pa.struct([("node", pa.int64()), ("words", pa.int64()), ("text", pa.string())])
        types = [long, long, pa.string(), pa.bool_(), long, pa.list_(pa.struct([("node", long), ("words", long), ("content", long)])), pa.list_(block)]
        for b in batches:
            rows = []
            for key, url, page in zip(*(b.column(k).to_pylist() for k in range(3))):
                marked, found = _keyed(_host(url), page)
                shown: dict[int, list[str]] = {}
                for node, _, text in found:
                    shown.setdefault(node, []).append(text)
                nodes = [{"node": n, "words": 0, "content": _node("\n".join(x))} for n, x in shown.items()]
                nodes += [{"node": n, "words": w, "content": 0} for n, w in {x[:2] for x in found}]
                rows.append((at, key, url, marked, _node("\n".join(x[2] for x in found)), nodes, [dict(zip(("node", "words", "text"), x)) for x in found]))
                at += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["row", "page_id", "url", "marked", "copy", "nodes", "blocks"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(parse, _PARSED)


def overruled(nodes: DataFrame, importance: float = 0.3, least_pages: int = 4) -> DataFrame:
    """(node, words) where the tree overrules the prior, of style nodes on at least `least_pages` different pages.

    words is 0 for a node kept by the prior whose entropy, over its most, is below `importance`, and for one cut by the prior that is not
    below it; else it is a text that so large a share of the node's pages show that less than `importance` is left.
    """
    seen = nodes.groupBy("node", "words", "content").agg(F.count_distinct("copy").alias("c"))
    whole = F.col("words") == 0
    often = F.when(~whole & (F.col("c") > least_pages * (1 - importance)), F.struct("words", "c"))
    total = seen.groupBy("node").agg(F.sum(F.when(whole, F.col("c"))).alias("m"), F.sum(F.when(whole, F.col("c") * F.log("c"))).alias("s"), F.collect_list(often).alias("often"))
    low = (F.log("m") - F.col("s") / F.col("m")) / F.log("m") < importance
    texts = F.transform(F.filter("often", lambda x: 1 - x["c"] / F.col("m") < importance), lambda x: x["words"])
    turned = F.concat(F.when(low == (F.col("node").bitwiseAND(1) == 1), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>")), texts)
    return total.where(F.col("m") >= least_pages).select("node", F.explode(turned).alias("words"))


def extract(pages: DataFrame, least: float = 0.1) -> DataFrame:
    """(page_id, url, text, n_chars) of each row.

    Where the tree would leave under `least` of a marked article, that stays whole. Null and empty html give an empty text. Null and
    repeated page ids keep a row each, judged by itself; a null url is a host of its own. Empty tables give empty ones; other columns are
    ignored. Whole pages of any length are read, each once.
    """
    ship(pages.sparkSession)
    source = stage(parsed(pages), "pages")
    nodes = source.select("row", "copy", F.inline("nodes"))
    low = stage(overruled(nodes), "overruled")
    hits = nodes.join(F.broadcast(low) if low.count() <= BROADCAST_ROWS else low, ["node", "words"])
    turned = stage(hits.groupBy("row").agg(F.collect_set(F.col("node").bitwiseXOR(F.col("words"))).alias("turned")), "turned")
    few = (turned.agg(F.sum(F.size("turned") + 1)).first()[0] or 0) <= BROADCAST_ROWS
    page = source.join(F.broadcast(turned) if few else turned, "row", "left").withColumn("turned", F.coalesce("turned", F.array().cast("array<bigint>")))
    prior = lambda x: x["node"].bitwiseAND(1) == 1
    stays = lambda x: (prior(x) != F.array_contains("turned", x["node"])) & ~F.array_contains("turned", x["node"].bitwiseXOR(x["words"]))
    size = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + F.when(prior(x), F.length(x["text"])).otherwise(0))
    page = page.withColumn("kept", F.filter("blocks", stays)).withColumn("kept", F.when(F.col("marked") & (size(F.col("kept")) < least * size(F.col("blocks"))), F.filter("blocks", prior)).otherwise(F.col("kept")))
    text = F.array_join(F.transform("kept", lambda x: x["text"]), "\n")
    return page.select("page_id", "url", text.alias("text")).select("*", F.length("text").cast("long").alias("n_chars"))
