"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags and text nodes, each told apart by the path of
block elements it stands in. Over the distinct pages of one host, a token's
occurrence vector says how often it occurs in each page. It is never
gathered: an exclusive-or of page hashes mixed with counts, and sums, identify it
and combine before the shuffle. Tokens that share a vector, are in at least half of
the host's pages and come as three or more, tags among them, form a valid class;
classes nest by the paths of their tags. Their text is the template; between their
tokens lie the slots. The main element is the innermost container that a valid class has
once in each of its pages and that holds more than ``MAJOR`` of what fills their slots;
where it is an article or main tag, others of that name on the page join it.
Inside it, an element that a class has once a page goes if its fillings repeat from
page to page while those of the main element don't, which is how notices and
adverts differ from titles. The main text is what else fills the main element's slots.

Hosts with fewer than ``LEAST`` distinct pages are taken together by the last two
labels of their names. Where that gives no template, or a page lacks its host's main
element, the names of elements and classes alone decide.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace

#: Pages a class must be in: a share of its host's, and a number; tokens it must have.
SUPPORT, LEAST, SIZE = 0.5, 4, 3
#: The share of the slot text of its pages that a main element holds more than.
MAJOR = 0.5
#: An element inside the main one goes if its share of distinct fillings is below this multiple of the main element's.
VARIED = 0.5
#: The share of its main elements' text beyond which what a page shares with its site is no template but copied text.
COPIED = 0.5
#: Tokens that a task combines before it hands them on.
HELD = 1 << 18

# What HTML calls its elements.
SKIPPED = ["script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "textarea", "select", "button", "head", "title"]
ASIDE = ["nav", "footer", "header", "aside", "form", "dialog", "menu"]
BLOCK = ["html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "hr", "details", "summary", "fieldset", "legend", "center"] + ASIDE + SKIPPED
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
MARKED = ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "sidebar", "menu", "navbar", "nav", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "comment", "comments", "disqus", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "search", "pagination", "pager", "widget", "toolbar", "copyright"]

_SKIPPED, _ASIDE, _BLOCK, _VOID, _MARKED = map(frozenset, (SKIPPED, ASIDE, BLOCK, VOID, MARKED))
_MAIN = frozenset(("article", "main"))
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template"))
_CLOSES_P = frozenset(BLOCK) - {"html", "body"}
_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NUMBER = re.compile(r"[0-9]{2,}")
_PART = re.compile(r"[a-z0-9]+")
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)"


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class Node:
    """An open block element: its token (a hash of its path), whether HTML sets it apart, whether its names do, and whether it is in a main element."""

    __slots__ = ("tag", "token", "up", "depth", "skipped", "aside", "named", "inside")

    def __init__(self, tag: str, names: str, up: Node | None, named: bool):
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        self.token = _hash(f"{up.token:x}/{tag}.{names}") if up else 0
        self.skipped = tag in _SKIPPED or up is not None and up.skipped
        self.aside = tag in _ASIDE or self.skipped or up is not None and up.aside
        self.named = named or up is not None and up.named
        self.inside = up is not None and up.inside


def _named(attributes: str) -> tuple[str, bool]:
    """The names an element goes by, longer numbers made alike, and whether one of them marks it as set apart."""
    if "=" not in attributes:
        return "", False
    names = [(m[1] or m[2] or m[3] or "").lower() for m in _NAMES.finditer(attributes)]
    return _NUMBER.sub("0", ".".join(names)), any(not _MARKED.isdisjoint(_PART.findall(n)) for n in names)


def parse(html: str) -> Iterator[tuple[str, str, Node, bool]]:
    """(kind, value, element, break): kind is ``<``, ``>`` or ``t``; break says that a new block starts here."""
    root = Node("", "", None, False)
    stack = [root]
    still_open: dict[str, int] = {}
    pos, n = 0, len(html)
    fresh = True
    while pos < n:
        at = html.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            yield "t", html[pos:at], stack[-1], fresh
            fresh = False
        if at == n:
            return
        m = _TAG.match(html, at)
        if not m:
            yield "t", "<", stack[-1], fresh
            fresh, pos = False, at + 1
            continue
        pos = m.end()
        if m[3] is None:
            continue
        tag, attributes = m[3].lower(), m[4] or ""
        if m[2]:
            if tag in _BLOCK:
                fresh = True
                if still_open.get(tag):
                    while stack[-1].tag != tag:
                        still_open[stack.pop().tag] -= 1
                    yield ">", tag, stack[-1], True
                    still_open[stack.pop().tag] -= 1
            continue
        if tag not in _BLOCK:
            if tag == "br":
                yield "t", " ", stack[-1], fresh
            continue
        fresh = True
        if stack[-1].tag == "p" and tag in _CLOSES_P:
            still_open[stack.pop().tag] -= 1
        elif stack[-1].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            still_open[stack.pop().tag] -= 1
        up = stack[-1]
        names, named = _named(attributes)
        node = Node(tag, names, up, named)
        yield "<", tag, node, True
        if tag in _VOID or attributes.endswith("/") and tag in _RAW:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
            if (stop := end.start() if end else n) > pos:
                yield "t", html[pos:stop], node, True
            yield ">", tag, node, True
            pos = end.end() if end else n
            continue
        stack.append(node)
        still_open[tag] = still_open.get(tag, 0) + 1


#: Kinds of tokens: the page itself, tags that open and close, text nodes; and the text nodes of one page only, by their element.
PAGE, OPEN, CLOSE, TEXT, SINGLE = range(5)


def _text(node: Node, words: list[str]) -> int:
    return _hash(f"{node.token:x} {' '.join(words)}")


def tokens(html: str) -> dict[int, list[int]]:
    """A page's tokens: hash -> [kind, times, characters, element it stands in, depth, whether it contains block elements].

    An element's characters are those of all text in it that HTML does not set apart.
    """
    out: dict[int, list[int]] = {0: [PAGE, 1, 0, 0, 0, 0]}
    for kind, value, node, _ in parse(html):
        if kind == "t":
            if not node.aside and (words := value.split()):
                got = out.setdefault(_text(node, words), [TEXT, 0, 0, node.token, 0, 0])
                chars = sum(map(len, words)) + len(words) - 1
                got[1] += 1
                got[2] += chars
                out[node.token][2] += chars
        elif kind == "<":
            out.setdefault(node.token, [OPEN, 0, 0, node.up.token, node.depth, 0])[1] += 1
            out[node.up.token][5] = 1
        else:
            out.setdefault(_hash(f">{node.token:x}"), [CLOSE, 0, 0, node.token, 0, 0])[1] += 1
    for row in sorted((r for r in out.values() if r[0] == OPEN), key=lambda r: -r[4]):
        out[row[3]][2] += row[2]
    return out


_M64 = (1 << 64) - 1


def _mixed(page: int, count: int) -> int:
    x = (page ^ (count * 0x9E3779B97F4A7C15 & _M64)) & _M64
    x = (x ^ x >> 31) * 0xD6E8FEB86659FD93 & _M64
    return x ^ x >> 32


_COLUMNS = {"host": pa.string(), "token": pa.int64(), "kind": pa.int32(), "vector": pa.int64(), "pages": pa.int64(), "times": pa.int64(), "least": pa.int64(), "most": pa.int64(), "chars": pa.int64(), "place": pa.int64(), "depth": pa.int32(), "container": pa.int32()}
_STATS = "host string, token long, kind int, vector long, pages long, times long, least long, most long, chars long, place long, depth int, container int"


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (host, html) -> parts of the vectors of their tokens; token 0 stands for the page itself."""
    part: dict[tuple[str, int], list] = {}

    def flush() -> pa.RecordBatch:
        keys, rows = list(part), list(part.values())
        cols = [[k[0] for k in keys], _signed([k[1] for k in keys])]
        for i in range(10):
            col = [r[i] for r in rows]
            cols.append(_signed(col) if i in (1, 4, 5, 7) else col)
        part.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _COLUMNS.values())], names=list(_COLUMNS))

    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = _hash(html)
            for token, (kind, n, chars, place, depth, container) in tokens(html).items():
                got = part.get((host, token))
                if got is None:
                    part[host, token] = [kind, _mixed(page, n), 1, n, page, page, chars, place, depth, container]
                    continue
                got[1] ^= _mixed(page, n)
                got[2] += 1
                got[3] += n
                got[4], got[5] = min(got[4], page), max(got[5], page)
                got[6] += chars
                got[9] |= container
        if len(part) > HELD:
            yield flush()
    if part:
        yield flush()


def classes(ws: Workspace, pages: DataFrame) -> DataFrame:
    """Statistics of each host's frequent tokens, with ``valid`` for those of valid classes, and of the fillings of elements.

    ``distinct`` and ``filled`` count an element's different and all text nodes outside the frequent ones.
    """
    parts = pages.mapInArrow(_occurrences, _STATS)
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    stats = parts.groupBy("host", "token", "kind").agg(F.bit_xor("vector").alias("vector"), *sums("pages", "times", "chars"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("place").alias("place"), F.min("depth").alias("depth"), F.max("container").alias("container"))
    # texts of one distinct page say nothing about the template, only how varied their element is
    single = (F.col("kind") == TEXT) & (F.col("least") == F.col("most"))
    short = stats.select("host", F.when(single, F.col("place")).otherwise(F.col("token")).alias("token"), F.when(single, SINGLE).otherwise(F.col("kind")).alias("kind"), F.when(single, 0).otherwise(F.col("vector")).alias("vector"), "pages", "times", "chars", F.when(~single, F.col("least")).alias("least"), F.when(~single, F.col("most")).alias("most"), F.when(single, F.lit(0)).otherwise(F.col("place")).alias("place"), "depth", "container")
    short = short.groupBy("host", "token", "kind").agg(F.bit_xor("vector").alias("vector"), *sums("pages", "times", "chars"), F.count(F.lit(1)).alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("place").alias("place"), F.min("depth").alias("depth"), F.max("container").alias("container"))
    short = ws.table(short)
    hosts = short.where(f"kind = {PAGE} and least != most").select("host", F.col("pages").alias("all_pages"))
    joined = short.join(hosts, "host")
    often = (F.col("kind").isin(OPEN, CLOSE, TEXT)) & (F.col("least") != F.col("most")) & (F.col("pages") >= SUPPORT * F.col("all_pages")) & (F.col("pages") >= LEAST)
    frequent = ws.table(joined.where(often | (F.col("kind") == PAGE)))
    valid = frequent.where(f"kind != {PAGE}").groupBy("host", "vector", "pages", "times").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("kind").isin(OPEN, CLOSE)).alias("tags"))
    valid = valid.where(F.col("tags") & (F.col("size") >= SIZE)).select("host", "vector", "pages", "times", F.lit(True).alias("valid"))
    told = frequent.join(valid, ["host", "vector", "pages", "times"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    # how varied the fillings of frequent elements are: of their other text nodes, those seen in one page and in several
    rare = joined.where((F.col("kind") == SINGLE) | (F.col("kind") == TEXT) & ~often)
    element = F.when(F.col("kind") == SINGLE, F.col("token")).otherwise(F.col("place"))
    fills = rare.groupBy("host", element.alias("token")).agg(F.sum("n").alias("distinct"), F.sum("times").alias("filled")).withColumn("kind", F.lit(OPEN))
    return told.join(fills, ["host", "token", "kind"], "left")


_DECIDED = "host string, mains array<long>, dropped array<long>, template array<long>"


def _decide(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One host's frequent tokens -> its main elements, the elements that go inside them, and its template's text."""
    table = sorted(rows.to_pylist(), key=lambda r: r["token"])
    up = {r["token"]: r["place"] for r in table if r["kind"] == OPEN}
    opens = {r["token"]: r for r in table if r["kind"] == OPEN}
    net = {t: r["chars"] for t, r in opens.items()}
    total = sum(r["chars"] for r in table if r["kind"] == PAGE)

    def above(token: int) -> Iterator[int]:
        while token in up:
            yield token
            token = up[token]

    kinds: dict[int, list[int]] = {t: [0, 0] for t in opens}
    for r in table:
        if r["kind"] == TEXT:
            if r["valid"]:
                total -= r["chars"]
            for t in above(r["place"]):
                net[t] -= r["chars"] if r["valid"] else 0
                if not r["valid"]:
                    kinds[t][0] += 1
                    kinds[t][1] += r["times"]
        elif r["kind"] == OPEN and r["filled"]:
            for t in above(r["token"]):
                kinds[t][0] += r["distinct"]
                kinds[t][1] += r["filled"]
    whole = sum(r["chars"] for r in table if r["kind"] == PAGE)
    if whole - total > COPIED * whole:  # what the pages share is copied text
        net, total = {t: r["chars"] for t, r in opens.items()}, whole
    count = max(r["pages"] for r in table if r["kind"] == PAGE)
    once = [r for r in opens.values() if r["valid"] and r["times"] == r["pages"]]
    able = [r["token"] for r in once if r["container"] and net[r["token"]] > MAJOR * total * r["pages"] / count]
    outer = {t for a in able for t in above(up[a])}
    mains = sorted(t for t in able if t not in outer)
    varied = lambda t: kinds[t][0] / kinds[t][1] if kinds[t][1] else 1.0
    inner = [(r["token"], m) for r in once for m in mains if m in above(up[r["token"]])]
    dropped = [t for t, m in inner if varied(t) < VARIED * varied(m)]
    text = [r["token"] for r in table if r["kind"] == TEXT and r["valid"]]
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), **{n: pa.array([v], pa.list_(pa.int64())) for n, v in (("mains", mains), ("dropped", dropped), ("template", text))}})


def templates(ws: Workspace, pages: DataFrame) -> DataFrame:
    """``(host, mains, dropped, template)`` for each host with a valid class.

    A frequent token is in half of its host's pages, so that a host has at most twice
    as many as a page of it has on average: a bounded group.
    """
    return ws.table(classes(ws, pages).groupBy("host").applyInArrow(_decide, _DECIDED))


class Template:
    """What a host's template decides, by token."""

    def __init__(self, mains=(), dropped=(), text=()):
        self.mains, self.dropped, self.text = frozenset(mains), frozenset(dropped), frozenset(text)


def _slots(html: str, template: Template) -> list[tuple[str, bool, bool]]:
    """(text, whether a block starts, whether the template has it) of the slots of the host's main elements."""
    out = []
    same = None  # an article or main tag that the host's main element has
    for kind, value, node, fresh in parse(html):
        if kind == "<":
            if node.token in template.mains:
                node.inside = True
                same = node.tag if node.tag in _MAIN else same
            elif node.tag == same and not node.aside:
                node.inside = True
            elif node.token in template.dropped:
                node.aside = True
        elif kind == "t" and node.inside and not node.aside:
            words = value.split()
            out.append((value, fresh, not words or _text(node, words) in template.text))
    return out


def _slots_by_name(html: str, template: Template) -> list[tuple[str, bool, bool]]:
    """The same for a page without a main element of its host's: elements' and classes' names say what is set apart."""
    found: list[tuple[bool, str, bool, bool]] = []
    any_main = False
    for kind, value, node, fresh in parse(html):
        if node.aside or node.named:
            continue
        if kind == "<" and node.tag in _MAIN:
            node.inside = any_main = True
        elif kind == "t":
            words = value.split()
            found.append((node.inside, value, fresh, bool(template.text) and (not words or _text(node, words) in template.text)))
    return [f[1:] for f in found if f[0] or not any_main]


def main_text(html: str | None, template: Template) -> str:
    """The blocks that fill the slots of the main element, joined by an empty line."""
    slots = _slots(html or "", template) if template.mains else []
    blocks: list[list[tuple[str, bool]]] = []
    for value, fresh, constant in slots or _slots_by_name(html or "", template):
        if fresh or not blocks:
            blocks.append([])
        blocks[-1].append((value, constant))
    done = [(" ".join(entities.unescape("".join(v for v, _ in b)).split()), all(c for _, c in b)) for b in blocks]
    # a block goes if the template has all of it; but a main element that is mostly such blocks is what near copies share
    shared = sum(len(v) for v, c in done if c)
    keep = bool(slots) and shared > COPIED * sum(len(v) for v, _ in done)
    return "\n\n".join(v for v, c in done if v and (keep or not c))


def sites(pages: DataFrame) -> DataFrame:
    """``(own, host)``: under which name each host's pages are taken together; a row for each host."""
    seen = pages.groupBy("own", F.xxhash64("html").alias("_page")).agg(F.lit(1).alias("_n")).groupBy("own").agg(F.count("_n").alias("_n"))
    return seen.select("own", F.when(F.col("_n") >= LEAST, F.col("own")).otherwise(F.concat(F.lit("*."), F.substring_index("own", ".", -2))).alias("host"))


def extract(pages: DataFrame) -> DataFrame:
    """Each row of ``pages(url, html, ...)`` with ``text`` and ``n_chars``.

    A null or empty page gives an empty text, as does one whose text is all set
    apart. Pages without a host share one template; pages of hosts with fewer than
    ``LEAST`` distinct pages share their site's, and where that has too few as well, or
    copies of one page only, pages are read by names alone. Repeated rows are each
    answered; columns called text or n_chars are replaced.
    """
    ws = Workspace(pages.sparkSession, "templates")
    own = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    named = ws.table(sites(pages.where("html is not null").select(own.alias("own"), "html")))
    known = templates(ws, pages.where("html is not null").select(own.alias("own"), "html").join(named, "own").select("host", "html"))
    kept = pages.drop("text", "n_chars")
    row = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), own.alias("own")).join(named, "own", "left")
    joined = row.join(known, "host", "left").select("row", "host", "mains", "dropped", "template")
    at = kept.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str | None, Template] = {}
        told = lambda column, i: np.asarray(column[i].values, np.int64).view(np.uint64).tolist() if column[i].is_valid else []
        for batch in batches:
            texts = []
            for i, (html, host) in enumerate(zip(batch.column(0).field(at).to_pylist(), batch.column(1).to_pylist())):
                if host not in seen:
                    if len(seen) > 64:
                        seen.clear()
                    seen[host] = Template(*[told(batch.column(j), i) for j in (2, 3, 4)])
                texts.append(main_text(html, seen[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["row", "text", "n_chars"])

    from pyspark.sql import types as T

    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(run, schema).select("row.*", "text", "n_chars")


def op4_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).drop("html")
