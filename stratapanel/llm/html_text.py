"""Main text of web pages: markup decides where it can, a suffix array over the pages of a host decides the rest.

Pages are cut into blocks; menus, forms, adverts and the like go by their elements, roles and names. The token
streams of a host's pages are then concatenated and their suffixes sorted; runs that recur on several pages are
boilerplate and are removed, unique runs stay. Pages of equal blocks are one content, and counts cover the whole host.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import arrow_schema, cut

#: Tokens of the shortest run that counts as repeated.
RUN = 8
#: Contents of a host whose streams are concatenated; larger hosts make several such groups, whose counts are summed.
GROUP_PAGES = 64
#: A run is boilerplate on so many distinct contents of a host. Inside articles it must also be on so many in a hundred.
LEAST_PAGES, ARTICLE_PERCENT = 3, 40

#: Tables up to so many hosts, or so many runs, are broadcast; beyond, pages are shuffled by host.
BROADCAST_HOSTS, BROADCAST_RUNS = 100_000, 1_000_000

_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^">]*+"|'[^'>]*+'|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PART = re.compile(r"[a-z]+|[0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?![A-Za-z0-9:-])[^>]*(?:>|\Z)", re.I) for tag in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOISE = frozenset("aside button canvas datalist dialog footer form head iframe map menu nav noscript object select svg template".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads advert advertisement adverts adsense sponsored sponsor promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar cookie cookies "
    "consent notice gdpr popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments respond reply replies disqus "
    "footer masthead toolbar pager pagination widget login".split()
)
_ARTICLE_NAMES = frozenset("articlebody".split())


def _is_noise(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element and all in it are left out."""
    if tag in _NOISE or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id"):
            parts = set(_NAME_PART.findall(value))
            if parts & _NAMES or "header" in parts and not in_article and not parts & {"article", "entry", "post"}:
                return True
    return False


def page_blocks(page: str) -> tuple[list[str], bool]:
    """The blocks of a page outside of its furniture, and whether they are those of an article.

    A page with an article or main element has only the blocks inside; of any other page all blocks count.
    """
    inside: list[str] = []
    outside: list[str] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, left out, part of the article
    open_at: dict[str, list[int]] = {}  # places on the stack by tag; "" has those of all block elements
    at, out, article, found = 0, False, False, False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                (inside if article else outside).append(text)
            parts.clear()

    def close(depth: int) -> None:
        nonlocal out, article
        while len(stack) > depth:
            name = stack.pop()[0]
            open_at[name].pop()
            if name not in _INLINE:
                open_at[""].pop()
        before = stack[-1][1:] if stack else (False, False)
        if before[1] != article:
            flush()
        out, article = before

    def top_block() -> tuple[int, str]:
        depth = open_at[""][-1] if open_at.get("") else -1
        return depth, stack[depth][0] if depth >= 0 else ""

    size = len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            if not out:
                parts.append(page[at:])
            break
        if start > at and not out:
            parts.append(page[at:start])
        m = _TAG.match(page, start)
        if not m:
            if not out:
                parts.append("<")
            at = start + 1
            continue
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            if not out:
                parts.append(" ")
            continue
        if m[1]:
            depth = open_at[tag][-1] if open_at.get(tag) else -1
            if tag not in _INLINE:
                flush()
            elif depth < top_block()[0]:
                continue  # an inline element is not closed across the block that is open inside it
            if depth >= 0:
                close(depth)
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag not in _INLINE:
            flush()
        depth, block = top_block()
        if block == "p" and tag in _CLOSES_P or tag in ("li", "dt", "dd", "td", "tr", "option") and block == tag:
            close(depth)  # with the inline elements left open in it
        if tag == "body" or tag in _NOISE and stack and stack[-1][0] == "head" and tag != "noscript":
            while stack and stack[-1][0] == "head":
                close(len(stack) - 1)
        if tag in _VOID or m[3].endswith("/"):
            continue
        was_in_article = article
        noise = out or _is_noise(tag, m[3], article)
        if not noise and (tag in ("article", "main") or 'role="main"' in m[3] or "articleBody" in m[3]):
            if not article:
                flush()
            article = found = True
        if noise and not out and tag in _INLINE:
            flush()
        out = noise
        open_at.setdefault(tag, []).append(len(stack))
        if tag not in _INLINE:
            open_at.setdefault("", []).append(len(stack))
        stack.append((tag, out, article))
        if noise:
            article = was_in_article
    flush()
    return (inside, True) if found else (outside, False)


def shared_runs(tokens: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the rank of the run of ``RUN`` tokens that starts there, and for each rank its distinct pages.

    Suffixes of the concatenated pages are sorted by prefix doubling, as far as ``RUN`` tokens: suffixes of equal
    rank then start with the same run. ``tokens`` holds a number of its own at the end of each page.
    """
    n = len(tokens)
    rank, length = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while length < RUN:
        step = min(length, RUN - length)
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + later
        order = np.argsort(key, kind="stable")
        ahead = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ahead[1:] != ahead[:-1])))
        length += step
    suffixes = np.argsort(rank, kind="stable")
    group, page = rank[suffixes], pages[suffixes]  # a stable sort keeps the pages of a group in order
    fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (page[1:] != page[:-1])))
    return rank, np.bincount(group, fresh, minlength=n)


def _covered(n: int, starts: np.ndarray) -> np.ndarray:
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + RUN, -1)
    return np.cumsum(marks[:-1]) > 0


def repeated_tokens(tokens: np.ndarray, pages: np.ndarray, least: int) -> np.ndarray:
    """Which tokens lie in a run of ``RUN`` tokens found on at least ``least`` distinct pages."""
    n = len(tokens)
    if n < RUN:
        return np.zeros(n, bool)
    rank, count = shared_runs(tokens, pages)
    return _covered(n, np.flatnonzero((count >= least)[rank] & (np.arange(n) <= n - RUN)))


def _stream(blocks: list[str]) -> list[str]:
    """The words of a content in order, each block followed by an empty word."""
    return [word for block in blocks for word in (*block.split(" "), "")]


def run_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of the runs of ``RUN`` words that start at each word."""
    known: dict[str, int] = {}
    hashes = np.array([known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)
    out = np.zeros(max(0, len(words) - RUN + 1), np.uint64)
    for k in range(RUN if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    return out.view(np.int64)


def unique_text(blocks: list[str], runs: np.ndarray) -> str:
    """The text of a page without the given runs."""
    if not len(runs):
        return " ".join(blocks)
    words = _stream(blocks)
    covered = _covered(len(words), np.flatnonzero(np.isin(run_hashes(words), runs)))
    tokens = np.array([bool(w) for w in words], np.int64)
    keep = _whole_or_long(tokens, ~covered)
    return " ".join(w for w, k in zip(words, keep, strict=True) if k and w)


def _whole_or_long(tokens: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Keeps the covered ends of blocks that a run only reaches into: a block goes whole, or by stretches of ``RUN`` tokens."""
    block = np.cumsum(tokens <= 0)
    whole = np.bincount(block, keep & (tokens > 0)) == 0
    borders = np.flatnonzero(np.concatenate(([True], (keep[1:] != keep[:-1]) | (block[1:] != block[:-1]), [True])))
    stretch = np.repeat(np.diff(borders), np.diff(borders))
    return keep | ~whole[block] & (stretch - (tokens <= 0) < RUN)


def least_pages(article: bool, contents: int) -> int:
    """On how many contents of a host a run is boilerplate."""
    return max(LEAST_PAGES, -(-ARTICLE_PERCENT * contents // 100)) if article else LEAST_PAGES


_RUNS = "host string, article boolean, n long, digest binary, run long"


def _group_runs(group: pa.Table) -> pa.Table:
    """Runs of one group of a host's contents that may be boilerplate there.

    The only group of a host has the runs that are. Of several groups of articles one has a common run on its share
    of contents at least, so the others need not name it; outside of articles each content names all its runs.
    """
    host, article, n = (group.column(name)[0].as_py() for name in ("host", "article", "n"))
    held = dict(zip(group.column("digest").to_pylist(), group.column("blocks").to_pylist(), strict=True))
    number: dict[str, int] = {"": 0}
    ids, owner, hashes = [], [], []
    for page, blocks in enumerate(held.values()):
        words = _stream(blocks)
        ids += [number.setdefault(w, len(number)) for w in words]
        ids.append(-page - 1)
        owner.append(len(words) + 1)
        starts = run_hashes(words)
        hashes += [starts, np.zeros(len(words) + 1 - len(starts), np.int64)]
    whole = np.concatenate([np.arange(k) <= k - 1 - RUN for k in owner])
    pages, run = np.repeat(np.arange(len(held)), owner), np.concatenate(hashes)
    if n <= GROUP_PAGES:
        least = least_pages(article, n)
    else:
        least = -(-ARTICLE_PERCENT * len(held) // 100) if article else 1
    rank, count = shared_runs(np.array(ids, np.int64), pages)
    at = np.flatnonzero(whole & (count >= least)[rank])
    if article:
        run, digest = np.unique(run[at]), None
    else:
        pairs = np.unique(np.stack([pages[at], run[at]]), axis=1)
        run, digests = pairs[1], list(held)
        digest = [digests[k] for k in pairs[0]]
    size = len(run)
    columns = [[host] * size, [article] * size, [n] * size, digest or [None] * size, run]
    schema = arrow_schema(_RUNS)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[str]], list[bool], list[bytes]]]:
    """Batches of page_id, url, host, html with the blocks of each page, whether of an article, and their digest."""
    for batch in batches:
        parsed = [page_blocks(page) for page in batch.column(3).to_pylist()]
        digests = [hashlib.blake2b("\n".join(blocks).encode("utf-8", "surrogatepass"), digest_size=16).digest() for blocks, _ in parsed]
        yield batch, [b for b, _ in parsed], [a for _, a in parsed], digests


_CONTENT = "host string, article boolean, digest binary, blocks array<string>"


def _contents(with_blocks: bool):
    """Each content of a host once in a task; without its blocks where only contents are counted."""
    schema = arrow_schema(_CONTENT if with_blocks else _CONTENT.rsplit(", ", 1)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple] = set()
        for batch, blocks, articles, digests in _read(batches):
            rows = []
            for row in zip(batch.column(2).to_pylist(), articles, digests, blocks, strict=True):
                if row[:3] not in met:
                    met.add(row[:3])
                    rows.append(row)
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)], schema=schema)

    return run


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of the runs beside it a content holds."""
    schema = arrow_schema("host string, digest binary, run long")
    for batch in batches:
        out: list[tuple] = []
        for host, digest, blocks, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out += [(host, digest, int(run)) for run in np.intersect1d(run_hashes(_stream(blocks)), np.array(runs, np.int64))]
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PAGE = f"page_id long, url string, {_CONTENT}"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_PAGE)
    for batch, blocks, articles, digests in _read(batches):
        arrays = [*batch.columns[:3], pa.array(articles, pa.bool_()), pa.array(digests, pa.binary()), pa.array(blocks, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("page_id long, url string, text string")
    for batch in batches:
        sizes, runs = pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy(zero_copy_only=False), batch.column(3)
        texts = [unique_text(blocks, runs[k].values.to_numpy() if sizes[k] else ()) for k, blocks in enumerate(batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], schema=schema)


def _spark(ddl: str) -> str:
    return ddl.replace("long", "bigint")


def _small(table: DataFrame, size: int, most: int) -> DataFrame:
    return F.broadcast(table) if size <= most else table


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per input row ``page_id``, ``url``, ``text``, ``n_chars``.

    Null html gives an empty text; a null url, or one without a host, belongs to the nameless host; null ids and
    repeated rows give rows of their own; an empty table none. Only the named columns are read. A page is parsed
    where it is read, once for each pass. Pages of equal blocks on a host are one content. Hosts of more than
    ``GROUP_PAGES`` contents are dealt into groups by the digest of the content, so a host that holds a third of all
    pages is spread out; what is boilerplate is settled by counts over the whole host.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    named = rows.mapInArrow(_contents(False), _CONTENT.rsplit(", ", 1)[0]).distinct()
    sizes = cut(named.groupBy("host", "article").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES))
    contents = rows.mapInArrow(_contents(True), _CONTENT)
    dealt = F.pmod(F.xxhash64("digest"), F.ceil(F.col("n") / GROUP_PAGES)).alias("group")
    groups = contents.join(_small(sizes, sizes.count(), BROADCAST_HOSTS), ["host", "article"]).select("host", "article", "n", dealt, "digest", "blocks")
    found = cut(groups.groupBy("host", "article", "n", "group").applyInArrow(_group_runs, _spark(_RUNS)))

    inside = found.filter("article").select("host", "n", "run").distinct()
    common = inside.filter(F.col("n") <= GROUP_PAGES).select("host", "run")
    unsettled = cut(inside.filter(F.col("n") > GROUP_PAGES))
    if n_open := unsettled.count():
        asked = unsettled.groupBy("host").agg(F.collect_list("run").alias("runs"))
        holding = contents.filter("article").join(_small(asked, n_open, BROADCAST_RUNS), "host").select("host", "digest", "blocks", "runs")
        held = holding.mapInArrow(_holding, "host string, digest binary, run bigint").distinct().groupBy("host", "run").agg(F.count("*").alias("n_pages"))
        share = F.ceil(ARTICLE_PERCENT * F.col("n") / 100)
        counted = held.join(unsettled, ["host", "run"]).filter(F.col("n_pages") >= F.greatest(share, F.lit(LEAST_PAGES)))
        common = common.unionByName(counted.select("host", "run"))
    of_host = cut(common.groupBy("host").agg(F.collect_set("run").alias("host_runs")).withColumn("article", F.lit(True)))

    outside = found.filter("NOT article").select("host", "digest", "run")
    often = outside.groupBy("host", "run").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= LEAST_PAGES)
    marked = outside.join(often, ["host", "run"], "left_semi").groupBy("host", "digest").agg(F.collect_list("run").alias("page_runs"))
    of_page = cut(marked.withColumn("article", F.lit(False)))

    parsed = rows.mapInArrow(_parse, _spark(_PAGE))
    runs = F.lit(None).cast("array<bigint>")
    for table, keys, column in ((of_host, ["host", "article"], "host_runs"), (of_page, ["host", "article", "digest"], "page_runs")):
        if size := table.agg(F.sum(F.size(column))).first()[0]:
            parsed, runs = parsed.join(_small(table, size, BROADCAST_RUNS), keys, "left"), F.coalesce(column, runs)
    texts = parsed.select("page_id", "url", "blocks", runs.alias("runs")).mapInArrow(_strip, "page_id bigint, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
