"""Main text of web pages by equivalence-class template deduction.

Every page gives tokens: its block tags, each in its path (an opening and its closing tag are one token), and its
blocks of text, each in its path. A token's occurrence vector over a host's distinct pages (by their html; copies
count once) is summed up as the xor of a hash of (page, count) over pages; tokens of a host with equal vectors that
most of its distinct pages share are an equivalence class. A class is valid if it holds two marks at least: a tag
(opening and closing), or a text and another token. Paths nest the classes into the host's template, whose nodes
are the slots that a page's text falls in, each into the innermost.

The texts of valid classes are the host's constant text and go; what is left in a slot varies. A slot's text over all
pages, without constant text and links, then leads from the root to the content (content_slot()): down to the
child that holds SLOT_SHARE of its parent's text, until the text lies in paragraphs or is spread over several slots. Only the
content slot's text is extracted, with a heading beside its way, and without the slots in it that are mostly links. Names of
tags and classes don't lead there; they rule out slots that are no content on any site (menus, adverts, comments and so on)
unless such a slot wraps the article.

A host with fewer than LEAST_PAGES distinct pages has no template, nor does a page without the content slot; where the content is
spread over the body there is no content slot either. There names decide alone: blocks outside an article or main go if
the page has one, else blocks that are mostly links. Constant text of fewer than CONSTANT_PAGES distinct pages stays, as
does that which makes up most of a page's content: such a page is a near-copy of others.

A host's template is as small as a page and is computed from partial sums, so that a host with a third of all pages is one
small row. Pages meet it in a join of two plain tables, in which the engine sends small tables of templates to all
executors and splits hosts with many pages.

Rows: null or empty html gives an empty text. A null url counts as the host "". Repeated rows and page
ids are separate pages. Unclosed and stray tags are tolerated. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.lineage import drop, written
from gneiss.llm.words import bounded_batches, mix, signed

#: A token of the template is on this share of a host's distinct pages.
SHARE = 0.6
LEAST_PAGES, CONSTANT_PAGES = 3, 8
#: The content slot's way leads through children that hold this share of their parent's varying text; a wrapper holds WRAPPER of it.
SLOT_SHARE, WRAPPER = 0.6, 0.9

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(script|style|noscript|template|svg|iframe|textarea|select|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!?\?*doctype[^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)(?:>|(?=<)|\Z)")
_NAME = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_WHITE = re.compile(r"\s+")
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open one of its group, up to the nearest container.
_CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_BARRED = frozenset("nav footer aside form head menu button dialog".split())
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notification popup promo promoted related reply replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget contentinfo complementary search login disclaimer alert".split())
_CONTENT = ("article", "main")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Steps whose names say nothing about what they are, and words that turn a name into one of another container.
_UNNAMED = _HEADINGS | {"html", "body", "main"}
_MODIFIERS = frozenset("has no with without".split())


def parse(source: str) -> tuple[list[tuple[str, str, float]], list[str]]:
    """Blocks (path, text, share of link text) and the paths of block tags, in page order."""
    source = _DROPPED.sub(" ", source)
    stack: list[tuple[str, str]] = []  # tag, path with it
    blocks, tags, text, links, total = [], [], [], 0, 0

    def flush():
        nonlocal links, total
        if text:
            plain = _WHITE.sub(" ", html.unescape("".join(text))).strip()
            if plain:
                blocks.append((where, plain, links / max(total, 1)))
            text.clear()
        links = total = 0

    where, depth, at = "", 0, 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            part = source[at : m.start()]
            text.append(part)
            size = len(part.strip())
            total += size
            links += size if depth else 0
        at = m.end()
        close, tag = m[1], m[2].lower()
        if tag == "a":
            depth = max(0, depth + (-1 if close else 1))
            continue
        if tag == "br":
            text.append(" ")
        if tag not in _BLOCKS:
            continue
        flush()
        depth = 0
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            for other in _CLOSES.get(tag, "p" if tag in _BLOCKS else "").split():
                if stack and stack[-1][0] == other:
                    stack.pop()
            name = ".".join(x for n in _NAME.findall(m[3]) for x in _SPLIT.split("".join(n).lower()) if x)
            path = f"{stack[-1][1] if stack else ''}/{tag}" + (f".{name}" if name else "")
            tags.append(path)
            if tag not in _VOID:
                stack.append((tag, path))
        where = stack[-1][1] if stack else ""
    if at < len(source):
        part = source[at:]
        text.append(part)
        total += len(part.strip())
    flush()
    return blocks, tags


def _token(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind} {value}".encode("utf-8", "surrogatepass")) or 1


@lru_cache(1 << 14)
def _tag(path: str) -> int:
    """The token of a tag in its path; 0 above the root."""
    return _token("t", path) if path else 0


def _steps_of(path: str) -> list[str]:
    """The path and those above it, from the root."""
    return [path[:k] for k in range(1, len(path)) if path[k] == "/"] + [path] if path else []


def _named(tag: str, names: list[str]) -> bool:
    """Whether a step's names mark it as something else than content."""
    if tag in _UNNAMED:
        return False
    words = zip(["", *names], names, [*names[1:], ""], strict=False)
    return any(n in _NAMES and before not in _MODIFIERS and not (n == "search" and after in ("result", "results")) for before, n, after in words)


def _steps(path: str) -> list[tuple[str, str, list[str]]]:
    """(path so far, tag, names) of each step."""
    out, so_far = [], ""
    for step in path.split("/")[1:]:
        so_far += f"/{step}"
        tag, *names = step.split(".")
        out.append((so_far, tag, names))
    return out


def _wrappers(blocks: list[tuple[str, str, float]]) -> set[str]:
    """Containers that hold the article: most of the page's text (that in articles, if there are any; headings don't
    count), and an article, main or h1 below them."""
    paths = [(_steps(p), len(t)) for p, t, _ in blocks]
    paths = [(s, n) for s, n in paths if not any(tag in _BARRED and tag != "form" for _, tag, _ in s)]
    paths = [x for x in paths if any(tag in _CONTENT for _, tag, _ in x[0])] or paths
    held, below, total = Counter(), set(), 0
    for steps, n in paths:
        for k, (_, tag, _) in enumerate(steps):
            if tag in _CONTENT or tag == "h1":
                below.update(p for p, _, _ in steps[:k])
        if steps and steps[-1][1] not in _HEADINGS:
            held.update({p: n for p, _, _ in steps})
            total += n
    return {p for p in below if 2 * held[p] > total}


def _barred(path: str, wrappers: set[str] | None = None) -> bool:
    inside = False
    for so_far, tag, names in _steps(path):
        if (tag in _BARRED and tag != "form") or (tag == "header" and not inside):
            return True
        if (tag == "form" or _named(tag, names)) and so_far not in (wrappers or ()):
            return True
        inside = inside or tag in _CONTENT
    return False


def _content(blocks: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    wrappers = _wrappers(blocks)
    kept = [b for b in blocks if not _barred(b[0], wrappers)]
    inner = [b for b in kept if any(s.split(".")[0] in _CONTENT for s in b[0].split("/"))]
    return inner or [b for b in kept if b[2] <= 0.5]


#: What a tag token is, as bits.
BARRED, ARTICLE, H1, PARAGRAPH, BODY = 1, 2, 4, 8, 16
_PARAGRAPHS = _HEADINGS | frozenset("p li td th dd dt pre blockquote figcaption caption center address".split())


@lru_cache(1 << 14)
def _flags(path: str) -> int:
    """Of the path's last step: BARRED by its tag or names, and its kind."""
    steps = _steps(path)
    _, tag, names = steps[-1]
    inside = any(t in _CONTENT for _, t, _ in steps[:-1])
    barred = tag in _BARRED or (tag == "header" and not inside) or _named(tag, names)
    return BARRED * barred | ARTICLE * (tag in _CONTENT) | H1 * (tag == "h1") | PARAGRAPH * (tag in _PARAGRAPHS) | BODY * (tag in ("html", "body"))


def page_tokens(source: str) -> dict[int, tuple[int, int, int, int, int]]:
    """Of each token of a page: count, parent, flags (-1 for a text), characters in it and below, those in links."""
    blocks, tags = parse(source)
    counts, chars, links = Counter(tags), Counter(), Counter()
    texts: dict[int, list[int]] = {}
    for path, text, share in blocks:
        linked = round(share * len(text))
        for step in _steps_of(path):
            chars[step] += len(text)
            links[step] += linked
        mine = texts.setdefault(_token("b", f"{path} {text}"), [0, _tag(path), -1, 0, 0])
        mine[0] += 1
        mine[3] += len(text)
        mine[4] += linked
    found = {_tag(p): (n, _tag(p.rpartition("/")[0]), _flags(p), chars[p], links[p]) for p, n in counts.items()}
    return found | {k: tuple(v) for k, v in texts.items()}


def content_slot(tags: dict[int, tuple[int, int, int, int]], texts: dict[int, tuple[int, int, int]]) -> tuple[int, list[int]]:
    """The token of the slot that holds a host's content (0: none), and the tokens of slots in it or headings beside it: those that are mostly
    links as they are, headings beside the way as -token.

    tags: parent, flags, characters, those in links; texts, the constant ones: parent, characters, those in links.
    """
    varying = {k: max(0, chars - links) for k, (_, _, chars, links) in tags.items()}
    for parent, chars, links in texts.values():
        while parent in tags:
            varying[parent] = max(0, varying[parent] - max(0, chars - links))
            parent = tags[parent][0]
    kids: dict[int, list[int]] = {}
    for k, (parent, *_) in tags.items():
        kids.setdefault(parent if parent in tags else 0, []).append(k)
    below = set()  # that have an article, main or h1 in them
    for k, (parent, flags, *_) in tags.items():
        while flags & (ARTICLE | H1) and parent in tags and parent not in below:
            below.add(parent)
            parent = tags[parent][0]

    def usable(k: int, whole: float) -> bool:
        return not tags[k][1] & BARRED or (k in below and varying[k] >= WRAPPER * whole)

    def own(k: int) -> float:
        return varying[k] - sum(varying[x] for x in kids.get(k, ()))

    at, way = 0, []
    while True:
        of = kids.get(at, [])
        whole = varying[at] if at else sum(varying[k] for k in of)
        good = [k for k in of if usable(k, whole)]
        rest = sum(varying[k] for k in good) + (max(0, own(at)) if at else 0)
        top = max(good, key=lambda k: (varying[k], k), default=0)
        if not top or rest <= 0 or varying[top] < SLOT_SHARE * rest:
            break
        leaf = 2 * own(top) >= varying[top]
        if leaf and tags[top][1] & PARAGRAPH:
            break
        way.append(top)
        at = top
        if leaf or tags[top][1] & ARTICLE:
            break
    # Paragraphs and headings beside the slot belong to it.
    while len(way) > 1 and not tags[way[-1]][1] & ARTICLE:
        beside = [k for k in kids[way[-2]] if k != way[-1] and usable(k, varying[way[-2]]) and tags[k][2] > 0]
        if not beside or not all(tags[k][1] & PARAGRAPH for k in beside):
            break
        way.pop()
    if not way or tags[way[-1]][1] & BODY:
        return 0, []
    inside, todo, linked, has_h1 = way[-1], list(kids.get(way[-1], [])), [], False
    while todo:
        k = todo.pop()
        has_h1 = has_h1 or bool(tags[k][1] & H1)
        if 2 * tags[k][3] > tags[k][2] and not tags[k][1] & PARAGRAPH:
            linked.append(k)
        else:
            todo += kids.get(k, [])
    above = [] if has_h1 else [-k for parent in way[:-1] for k in kids[parent] if tags[k][1] & H1 and tags[k][2] > 0]
    return inside, linked + above


def _inside(path: str, slot: int, dropped: frozenset[int]) -> str | None:
    """The path from the slot on, if the block is in it and in none of its slots that go."""
    steps = _steps_of(path)
    tokens = [_tag(x) for x in steps]
    if slot not in tokens or not dropped.isdisjoint(tokens):
        return None
    return path[len(steps[tokens.index(slot)]) :]


def main_text(source: str, constant: frozenset[int] = frozenset(), slot: int = 0, beside: frozenset[int] = frozenset()) -> str:
    """The blocks of the content, two line feeds apart. The rest is the template of the page's host: its constant text, and its content slot as of content_slot()."""
    blocks, _ = parse(source)
    varies = [_token("b", f"{p} {t}") not in constant for p, t, _ in blocks] if constant else [True] * len(blocks)
    if slot:
        heads, known = frozenset(-k & (2**64 - 1) for k in beside if k < 0), {}
        dropped = frozenset(k & (2**64 - 1) for k in beside if k >= 0)
        kept = []
        for (path, text, _), new in zip(blocks, varies, strict=True):
            if path not in known:
                inner = _inside(path, slot, dropped)
                known[path] = (inner is not None and not _barred(inner)) or (inner is None and _tag(path) in heads)
            if known[path]:
                kept.append((text, new))
        own = [t for t, new in kept if new]
        # Most of a near-copy's text is that of other pages: nothing of it is a template.
        if 2 * sum(map(len, own)) < sum(len(t) for t, _ in kept):
            own = [t for t, _ in kept]
        if own:
            return "\n\n".join(own)
    whole = _content(blocks)
    rest = _content([b for b, new in zip(blocks, varies, strict=True) if new]) if constant else whole
    if 2 * sum(len(t) for _, t, _ in rest) < sum(len(t) for _, t, _ in whole):
        rest = whole
    return "\n\n".join(t for _, t, _ in rest)


_COLUMNS = "host bigint, token bigint, vector bigint, pages bigint, parent bigint, flags int, chars bigint, links bigint"


def _distinct_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, tokens) for the distinct pages of each batch; six numbers for each token."""
    bits = 2**64 - 1
    for batch in batches:
        hosts, pages = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        first = list({(h, p): i for i, (h, p) in reversed(list(enumerate(zip(hosts, pages, strict=True))))}.values())
        tokens = []
        for i in first:
            found = page_tokens(batch.column(1)[i].as_py() or "")
            rows = [(k, n, up, flags & bits, chars, links) for k, (n, up, flags, chars, links) in found.items()]
            tokens.append(np.array(rows, np.uint64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([hosts[i] for i in first], pa.int64()), pa.array([pages[i] for i in first], pa.int64()), pa.array(tokens, pa.binary())], names=["host", "page", "tokens"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each host with their vectors and sums over each batch of distinct pages; token 0 counts the host's pages."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        host, page = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        each = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, 6) for x in batch.column(2)]
        row = np.concatenate([np.arange(n), np.repeat(np.arange(n), [len(x) for x in each])])
        t = np.concatenate([np.zeros((n, 6), np.uint64), *each])
        order = np.lexsort((t[:, 0], host[row]))
        h, t, v = host[row][order], t[order], mix(t[:, 1] * np.uint64(0x9E3779B97F4A7C15) + page[row])[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:, 0] != t[:-1, 0])]))
        sums = lambda k: np.add.reduceat(t[:, k].view(np.int64), first)
        pages = np.diff(np.concatenate([first, [len(h)]])).astype(np.int64)
        arrays = [h[first], signed(t[first, 0]), signed(np.bitwise_xor.reduceat(v, first)), pages, signed(t[first, 2]), t[first, 3].view(np.int64).astype(np.int32), sums(4), sums(5)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in arrays], names=["host", "token", "vector", "pages", "parent", "flags", "chars", "links"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, constant, slot, beside) from the tokens of each host's valid classes."""
    for batch in batches:
        slots, besides, constants = [], [], []
        bits, back = lambda x: x & (2**64 - 1), lambda x: x - (1 << 64) if x >> 63 else x
        for tokens in batch.column(1).to_pylist():
            tags = {bits(x["token"]): (bits(x["parent"]), x["flags"], x["chars"], x["links"]) for x in tokens if x["flags"] >= 0}
            texts = {bits(x["token"]): (bits(x["parent"]), x["chars"], x["links"]) for x in tokens if x["flags"] < 0}
            slot, beside = content_slot(tags, texts)
            slots.append(back(slot))
            besides.append([{"token": back(abs(x)), "heading": x < 0} for x in beside])
            constants.append([x["token"] for x in tokens if x["flags"] < 0])
        kind = pa.list_(pa.struct([("token", pa.int64()), ("heading", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(constants, pa.list_(pa.int64())), pa.array(slots, pa.int64()), pa.array(besides, kind)], names=["host", "constant", "slot", "beside"])


_TEMPLATE = "host bigint, constant array<bigint>, slot bigint, beside array<struct<token:bigint,heading:boolean>>"


def templates(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, constant, slot, beside): the template of each host with enough distinct pages. pages: host, html."""
    distinct = pages.select("host", "html", F.xxhash64("html").alias("page")).mapInArrow(_distinct_pages, "host bigint, page bigint, tokens binary").dropDuplicates(["host", "page"])
    counted = distinct.mapInArrow(_occurrences, _COLUMNS).groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), *[F.sum(c).alias(c) for c in ("pages", "chars", "links")], *[F.max(c).alias(c) for c in ("parent", "flags")])
    counted = written(counted.filter((F.col("token") == 0) | (F.col("pages") > 1)), "occurrences")
    of_host = counted.filter("token = 0").filter(F.col("pages") >= least).select("host", F.col("pages").alias("all"))
    often = counted.filter("token <> 0").join(of_host, "host").filter(F.col("pages") >= F.col("all") * share)
    # At most (tokens of a page) / share tokens of a host are left: they fit in one row.
    parts = F.struct("token", "parent", "flags", "chars", "links")
    classes = often.groupBy("host", "all", "vector").agg(F.collect_list(parts).alias("class"))
    valid = F.filter("class", lambda x: (x["flags"] >= 0) | ((F.size("class") > 1) & (F.col("all") >= CONSTANT_PAGES)))
    by_host = classes.groupBy("host").agg(F.flatten(F.collect_list(valid)).alias("tokens"))
    out = written(by_host.mapInArrow(_decided, _TEMPLATE), "templates")
    drop(counted)
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, tuple] = {}
    bits = 2**64 - 1
    for batch in batches:
        hosts, out = batch.column(3).to_pylist(), []
        for i, source in enumerate(batch.column(2).to_pylist()):
            host = hosts[i]
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                constant, slot, beside = (batch.column(c)[i].as_py() for c in (4, 5, 6))
                known[host] = (frozenset(x & bits for x in constant or ()), (slot or 0) & bits, frozenset((-1 if x["heading"] else 1) * (x["token"] & bits) for x in beside or ()))
            out.append(main_text(source or "", *known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    bounded_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "^.*?://", ""), "^[^/?#]*", 0))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.xxhash64(host).alias("host"))
    found = templates(rows, least, share).withColumnRenamed("host", "h")
    joined = rows.join(found, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "host", "constant", "slot", "beside")
    return joined.mapInArrow(_texts, "page_id bigint, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
