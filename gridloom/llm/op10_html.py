"""Main text of HTML pages, with a suffix array per host for boilerplate.

A page becomes blocks of text, each with what its place says: dropped (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments), in an article, in a main element, or open (anything else). The blocks of articles are the page's text. For a page without an
article, its main blocks, or else its open ones, are judged by the host's suffix array: the token streams of its pages (in chunks of bounded size, by a
hash of the blocks) are concatenated, a suffix array finds the runs of tokens of each chunk, their distinct pages are added up over all chunks of the host, blocks
that runs of several pages cover are boilerplate, and the unique ones stay. Text inside an article is never taken away for being repeated: mirrored pages and quoted passages are content.
structure=False leaves everything but scripts and styles to the suffix array.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import partial
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import FILE, ROW, attach, groups_of, materialize, with_address
from .op3_superminhash import GOLDEN, WordHashes, mix

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe".split())
DROP_TAGS = frozenset("nav footer aside form button dialog menu head object canvas audio video select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset(["br", "td", "th", "wbr"])
#: Elements that end an open p; and those of which an open one ends at the next.
CLOSES_P = BLOCKS - {"html", "body", "head"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}, "p": {"p"}}
SCOPES = frozenset("ul ol dl table article section div main body html td th form nav aside header footer blockquote".split())
DROP_WORDS = frozenset(
    "nav navbar navigation menu menubar sidebar footer ad ads adv advert adverts advertisement advertising adsbygoogle banner promo sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social comment comments respond reply replies disqus related recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets toolbar masthead topbar login search skip".split()
)
#: Words that a class name may have besides: "comment-list" is one of comments, "related-work" and "social-policy" are not what they begin with.
PART_WORDS = frozenset("list box bar block container wrapper wrap inner outer section area item items left right top bottom main site page global primary secondary header body content link links button buttons form text message messages icon icons title group module panel slot unit inline".split())
NAME_WORDS = DROP_WORDS | PART_WORDS
#: Words that say the element only has, or has not, such a part; and what whole class names mark an article that isn't the page's.
RELATION_WORDS = frozenset("with has no without".split())
SMALL_ARTICLES = frozenset("comment comments reply ad advert advertisement sponsored promo related".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
TAG = re.compile(r"""<(?:!--(?P<comment>)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>|[!?][^>]*>|/[^a-zA-Z][^>]*>)""")
ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
CHUNK_PAGES = 512
#: Tokens of a run, and distinct pages of a host from which on it is boilerplate, however many pages the host has.
RUN, LEAST_PAGES = 6, 3


def _dropped(name: str, attrs: str, in_main: bool) -> bool:
    if name in DROP_TAGS or name == "header" and not in_main:
        return True
    if "=" not in attrs:
        return False
    for key, a, b, c in ATTR.findall(attrs):
        value = (a or b or c).lower()
        if key.lower() == "role":
            if value.strip() in DROP_ROLES:
                return True
            continue
        for token in value.split() if name not in ("html", "body") else ():
            words = WORDS.findall(token) if name not in ("article", "main") else [token] if token in SMALL_ARTICLES else []
            if not RELATION_WORDS.isdisjoint(words) or not NAME_WORDS.issuperset(words):
                continue
            if not DROP_WORDS.isdisjoint(words) or words[:1] == ["header"] and not in_main:
                return True
    return False


def blocks_of(page: str, structure: bool = True) -> list[tuple[str, int]]:
    """Blocks with text that aren't dropped, in page order, and their place: 1 open, 2 in main, 3 in an article (without structure: all open).

    One pass whose time grows with the page: open elements are found by the places of their names on the stack, never by a walk over it.
    """
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, dropped, place
    where: dict[str, list[int]] = {}  # places of each open name, and of all scopes
    scopes: list[int] = [-1]
    endless: set[str] = set()  # raw elements that no end tag follows any more
    drop, place = False, 1
    at, n = 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((text, place))
            held.clear()

    def pop_to(i: int) -> None:
        nonlocal drop, place
        while len(stack) > i:
            name = stack.pop()[0]
            where[name].pop()
            if name in SCOPES:
                scopes.pop()
        drop, place = (stack[-1][1], stack[-1][2]) if stack else (False, 1)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not drop:
            text = page[at:lt]
            held.append(entities.unescape(text) if "&" in text else text)
        if lt == n:
            break
        m = TAG.match(page, lt)
        if m is None:
            close = page.find(">", lt)
            if close < 0 and lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] in "/!?"):
                break  # cut off inside a tag
            if lt + 1 < n and page[lt + 1].isalpha():  # an open quote: up to the next >
                at = close + 1
                continue
            if not drop:
                held.append("<")
            at = lt + 1
            continue
        at = m.end()
        comment, end, name, attrs = m.groups()
        if comment is not None:
            close = page.find("-->", lt + 4)
            at = n if close < 0 else close + 3
            continue
        if name is None:
            continue
        name = name.lower()
        if end:
            if name in BLOCKS:
                flush()
            elif name in SPACED:
                held.append(" ")
            if places := where.get(name):
                if name in SCOPES or places[-1] > scopes[-1]:  # a stray end tag doesn't leave its container
                    pop_to(places[-1])
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/") or name in ("script", "style", "textarea", "title"):
                close = None if name in endless else RAW_END[name].search(page, at)
                if close:
                    at = close.end()
                else:
                    endless.add(name)
                    at = n if name in ("script", "style") else at
            continue
        if name in BLOCKS:
            flush()
        elif name in SPACED:
            held.append(" ")
        closes = SIBLINGS.get(name, ()) if name not in CLOSES_P else (*SIBLINGS.get(name, ()), "p")
        top = max((where[c][-1] for c in closes if where.get(c)), default=-1)
        if top > scopes[-1]:
            pop_to(top)
        if name in VOID or attrs.endswith("/") and name not in BLOCKS:
            continue
        if structure:
            drop = drop or _dropped(name, attrs, place > 1)
            place = max(place, 3 if name == "article" else 2 if name == "main" or 'role="main"' in attrs else 1)
        where.setdefault(name, []).append(len(stack))
        if name in SCOPES:
            scopes.append(len(stack))
        stack.append((name, drop, place))
    flush()
    return out


def main_blocks(blocks: list[tuple[str, int]]) -> list[str] | None:
    """Blocks of the articles; None if there are none."""
    found = [t for t, p in blocks if p == 3]
    return found or None


def open_blocks(blocks: list[tuple[str, int]]) -> list[str]:
    """Blocks on which the suffix array decides: those of main without an article, else the open ones."""
    places = {p for _, p in blocks}
    want = 2 if 2 in places and 3 not in places else 1
    return [t for t, p in blocks if p == want]


def suffix_array(s: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first `length` tokens, by prefix doubling, and their ranks (equal for equal prefixes).

    s: non-negative integers; beyond its end there is a token less than any.
    """
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while k < length:
        step = min(k, length - k)
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + nxt, return_inverse=True)[1].astype(np.int64) + 1
        k += step
    return np.argsort(rank, kind="stable"), rank


def repeated_tokens(streams: list[np.ndarray], run: int, pages: int) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run of at least `run` tokens that occurs in at least `pages` distinct streams.

    Equal streams count once. Runs never cross a stream's end.
    """
    if len(streams) < pages:
        return [np.zeros(len(x), bool) for x in streams]
    unique: dict[bytes, int] = {}
    number = np.array([unique.setdefault(x.tobytes(), len(unique)) for x in streams])
    sizes = np.array([len(x) for x in streams])
    s = np.concatenate([np.concatenate([x, [0]]) for x in streams])  # a 0 ends each
    owner = np.repeat(number, sizes + 1)
    order, rank = suffix_array(s, run)
    left = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1) - np.arange(len(s))
    fits = left >= run
    pairs = np.unique(np.stack([rank[fits], owner[fits]], 1), axis=0)[:, 0] if fits.any() else np.empty(0, np.int64)
    often = np.bincount(pairs, minlength=int(rank.max()) + 1) >= pages
    start = fits & often[rank]
    delta = np.zeros(len(s) + run + 1, np.int64)
    at = np.flatnonzero(start)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + run, -1)
    cover = np.cumsum(delta)[: len(s)] > 0
    ends = np.cumsum(sizes + 1)
    return [cover[e - 1 - n : e - 1] for e, n in zip(ends.tolist(), sizes.tolist())]


def stream_of(blocks: list[str], hashes: WordHashes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Hashes of a page's words with a mark between blocks, and the start and end of each block."""
    x, at = [1], []
    for b in blocks:
        words = b.split()
        at.append((len(x), len(x) + len(words)))
        x += [hashes[w.encode()] for w in words]
        x.append(1)
    return np.array(x, np.uint64), at


def run_hashes(x: np.ndarray, run: int = RUN) -> np.ndarray:
    """A hash for each run of tokens."""
    n = max(0, len(x) - run + 1)
    h = np.full(n, run, np.uint64)
    for i in range(run):
        h = mix(h * GOLDEN + x[i : n + i])
    return h


def unique_blocks(blocks: list[str], often: np.ndarray, hashes: WordHashes, run: int = RUN, covered: float = 0.8) -> list[str]:
    """The blocks of a page that runs of `often` don't cover."""
    x, spans = stream_of(blocks, hashes)
    at = np.flatnonzero(np.isin(run_hashes(x, run), often))
    delta = np.zeros(len(x) + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + run, -1)
    cover = np.cumsum(delta)[: len(x)] > 0
    return [b for b, (s, e) in zip(blocks, spans) if cover[s:e].mean() < covered]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def _parse(batches: Iterator[pa.RecordBatch], structure: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, opens, hosts = [], [], []
        for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
            blocks = blocks_of(page or "", structure)
            main = main_blocks(blocks)
            texts.append(None if main is None else "\n".join(main))
            opens.append(open_blocks(blocks))
            hosts.append(host_of(url))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column(FILE), b.column(ROW), pa.array(hosts, pa.string()), pa.array(texts, pa.string()), pa.array(opens, pa.list_(pa.string()))], names=["page_id", "url", FILE, ROW, "host", "text", "open"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a chunk of distinct pages, by a suffix array, and in how many of the pages each occurs."""
    hashes = WordHashes()
    for t in groups_of(batches, ["host", "chunk"]):
        streams = [stream_of(x, hashes)[0] for x in t.column("open").to_pylist()]
        sizes = np.array([len(x) for x in streams])
        s = np.concatenate([np.concatenate([x, np.zeros(1, np.uint64)]) for x in streams])  # a 0 ends each
        owner = np.repeat(np.arange(len(streams)), sizes + 1)
        rank = suffix_array(s, RUN)[1]
        left = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1) - np.arange(len(s))
        fits = np.flatnonzero(left >= RUN)
        if not len(fits):
            continue
        ranks, first = np.unique(rank[fits], return_index=True)
        pages = np.bincount(np.unique(np.stack([rank[fits], owner[fits]], 1), axis=0)[:, 0])[ranks]
        runs = run_hashes(s)[fits[first]]
        n = len(runs)
        yield pa.RecordBatch.from_arrays([pa.array([t.column("host")[0].as_py()] * n, pa.string()), pa.array(np.full(n, t.column("chunk")[0].as_py(), np.int64)), pa.array(runs.view(np.int64)), pa.array(pages.astype(np.int64))], names=["host", "chunk", "run", "pages"])


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a chunk (kind 0) come right before its pages (kind 1)."""
    hashes = WordHashes()
    at, runs, often = None, [], np.empty(0, np.uint64)
    for b in batches:
        out = []
        for host, chunk, kind, run, blocks, file, row in zip(*(b.column(c).to_pylist() for c in ("host", "chunk", "kind", "run", "open", FILE, ROW))):
            if at != (host, chunk):
                at, runs, often = (host, chunk), [], None
            if kind == 0:
                runs.append(run)
                continue
            if often is None:
                often = np.array(runs, np.int64).view(np.uint64)
            out.append((file, row, "\n".join(unique_blocks(blocks, often, hashes))))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=[FILE, ROW, "text"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", structure: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed. A null or empty
    page, or one with boilerplate alone, gives an empty text. A null or odd url is a host of its own name "". Repeated rows are pages of
    their own, but equal streams count as one where repeats are looked for. Other columns are not read. Very long pages take time in proportion.
    """
    rows = with_address(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    kind = rows.schema["page_id"].dataType.simpleString()
    parsed = materialize(rows.mapInArrow(partial(_parse, structure=structure), f"page_id {kind}, url string, {FILE} long, {ROW} long, host string, text string, open array<string>"), "parsed-pages")
    loose = parsed.filter(F.size("open") > 0).select("host", F.col("text").isNull().alias("need"), "open", FILE, ROW)
    hosts = materialize(loose.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("any")), "hosts")
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / CHUNK_PAGES).cast("long")
    placed = attach(loose, hosts, "host", "n", unique=F.xxhash64(FILE, ROW)).filter(F.coalesce("any", "need"))  # hosts that need no decision go no further
    # equal pages meet in one chunk, so that the chunks' counts add up
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("open"), chunks)).select("host", "chunk", "need", "open", FILE, ROW)
    distinct = placed.select("host", "chunk", "open").distinct().repartition("host", "chunk").sortWithinPartitions("host", "chunk")
    runs = materialize(distinct.mapInArrow(_runs, "host string, chunk long, run long, pages long"), "runs")
    often = runs.groupBy("host", "run").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= LEAST_PAGES).select("host", "run")
    none = lambda kind: F.lit(None).cast(kind)
    both = runs.join(often, ["host", "run"]).select("host", "chunk", F.lit(0).alias("kind"), "run", none("array<string>").alias("open"), none("long").alias(FILE), none("long").alias(ROW))
    both = both.unionByName(placed.filter("need").select("host", "chunk", F.lit(1).alias("kind"), none("long").alias("run"), "open", FILE, ROW))
    both = both.repartition("host", "chunk").sortWithinPartitions("host", "chunk", "kind")
    found = both.mapInArrow(_unique, f"{FILE} long, {ROW} long, text string")
    keep = ("page_id", "url")
    sure = parsed.filter(F.col("text").isNotNull() | (F.size("open") == 0)).select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    other = parsed.filter(F.col("text").isNull() & (F.size("open") > 0)).select(*keep, FILE, ROW).join(found, [FILE, ROW], "left").select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    return sure.unionByName(other).select(*keep, "text", F.length("text").cast("long").alias("n_chars"))


def op10_host_suffix_array(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
