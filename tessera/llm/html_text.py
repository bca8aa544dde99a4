"""Main text of web pages: blocks by the structure of the page, then a suffix array over the token streams of a host."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.minhash import mixed
from tessera.llm.words import grouped_texts
from tessera.plans.scratch import Scratch

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*+> | <(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)> | </?[a-zA-Z][^>]*+> | [^<]++ | <""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Elements by what a parser or a reader does with them.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer menu dialog select button fieldset head".split())
SELDOM = frozenset("header aside form".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br".split()
)
CELLS = frozenset("td th".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
COMMENT_NAMES = frozenset("comment comments feedback reply replies disqus discussion respond responses".split())
CHROME_NAMES = COMMENT_NAMES | frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adsense advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended login search searchbox pagination pager toolbar widget".split()
)
# Inside an article these may as well name its subject or a part of it: a list of dishes, a lead, a quoted form.
UNSURE_NAMES = frozenset("menu banner search searchbox fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# The last part of a name tells what an element is, but for parts that tell of its shape or place.
SHAPES = frozenset(
    "area bar block body bottom box button buttons center col column container content group holder inner item items left link links list outer panel primary region right row secondary section slot small text top unit widgets wrap wrapper zone".split()
)
FURTHER_READING = frozenset("articles news pages posts reading stories videos".split())
TITLED = frozenset("article content entry page post section story".split())
# A name such as `has-sidebar` or `ad-free` tells about what is beside an element.
NEGATED = frozenset("has with no without free".split())
NAME_PARTS = re.compile(r"[^a-z0-9]+")
PLAIN, UNSURE, MAYBE, CHROME = range(4)
#: Where a block stands: in the main text, or where boilerplate is likelier.
MAIN, ASIDE = 0, 1


def named(mark: str) -> str | None:
    """What an element of this class or id is, if that is no part of an article."""
    parts = NAME_PARTS.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", mark).lower())
    if not NEGATED.isdisjoint(parts):
        return None
    while len(parts) > 1 and (not parts[-1] or parts[-1] in SHAPES or any(c.isdigit() for c in parts[-1])):
        parts.pop()
    last, before = parts[-1], parts[-2] if len(parts) > 1 else ""
    if last in FURTHER_READING and before in ("related", "recommended"):
        return before
    if last not in CHROME_NAMES or (last == "header" and before in TITLED):
        return None
    return last


def kind_of(tag: str, attributes: str, in_text: bool) -> tuple[int, bool]:
    """Whether an element is chrome for certain, maybe, hardly or not at all, and whether it holds readers' comments."""
    kind = UNSURE if in_text and tag in UNSURE_NAMES else CHROME if tag in NEVER else MAYBE if tag in SELDOM and not (tag == "header" and in_text) else PLAIN
    comments = False
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            found = set(filter(None, map(named, value.split())))
            comments = comments or not COMMENT_NAMES.isdisjoint(found)
            if found and tag not in ("html", "body", "main", "article") or comments and tag == "article":
                kind = max(kind, UNSURE if in_text and found <= UNSURE_NAMES else MAYBE)
        elif name == "role" and value.lower() in CHROME_ROLES and tag not in ("html", "body", "main", "article"):
            kind = max(kind, MAYBE)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            kind = CHROME
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            kind = CHROME
    return kind, comments


@dataclass
class Element:
    tag: str
    kind: int
    comments: bool
    outer: bool = False


class PageReader:
    """Blocks of a page as (text, whether in an article or main element, number of the outermost element that may be chrome or
    -1, whether in an element of an article that is hardly chrome)."""

    def __init__(self, page: str) -> None:
        self.blocks: list[tuple[str, bool, int, bool]] = []
        self.maybe: list[Element] = []
        self.parts: list[str] = []
        self.stack: list[Element] = []
        self.skipping = self.zones = self.marked = self.unsure = 0
        # Chrome inside a line: its tag, how many such tags are open, and the depth of the stack where it began.
        self.inline: tuple[str, int, int] | None = None
        self.read(page)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.blocks.append((text, self.zones > 0, len(self.maybe) - 1 if self.marked else -1, self.unsure > 0))

    def add(self, text: str) -> None:
        if not self.skipping and self.inline is None:
            self.parts.append(text)

    def push(self, tag: str, attributes: str) -> None:
        kind, comments = kind_of(tag, attributes, self.zones > 0)
        element = Element(tag, kind, comments)
        if kind == MAYBE:
            element.outer = not self.marked
            self.marked += 1
            if element.outer:
                self.maybe.append(element)
        self.stack.append(element)
        self.skipping += kind == CHROME
        self.unsure += kind == UNSURE
        self.zones += tag in ("article", "main")

    def pop(self) -> None:
        element = self.stack[-1]
        if element.tag in CELLS:
            self.add(" ")
        else:
            self.flush()
        self.stack.pop()
        self.skipping -= element.kind == CHROME
        self.marked -= element.kind == MAYBE
        self.unsure -= element.kind == UNSURE
        self.zones -= element.tag in ("article", "main")
        if self.inline and self.inline[2] > len(self.stack):
            self.inline = None

    def close(self, among: set[str] | frozenset[str], bounds: set[str] | frozenset[str] = frozenset()) -> None:
        """Ends the innermost open element of these tags, unless one of bounds is further in."""
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag in among:
                while len(self.stack) > depth:
                    self.pop()
                return
            if self.stack[depth].tag in bounds:
                return

    def end(self, tag: str) -> None:
        if tag in INLINE:
            if self.inline and self.inline[0] == tag:
                self.inline = (tag, self.inline[1] - 1, self.inline[2]) if self.inline[1] > 1 else None
        elif tag == "p" and not any(e.tag == "p" for e in self.stack):
            self.flush()
        else:
            self.close({tag})

    def begin(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self.add(" ")
            elif self.inline:
                if self.inline[0] == tag and tag not in VOID:
                    self.inline = (tag, self.inline[1] + 1, self.inline[2])
            elif attributes and tag not in VOID and kind_of(tag, attributes, True)[0] > UNSURE:
                self.inline = (tag, 1, len(self.stack))
            return
        if tag in CLOSES_P:
            self.close({"p"}, frozenset(("td", "th", "table", "button", "body")))
        if tag in SIBLINGS:
            self.close(SIBLINGS[tag], BOUNDS[tag])
        if tag == "body":
            self.close({"head"})
        if tag in CELLS:
            self.add(" ")
        else:
            self.flush()
        if tag not in VOID:
            self.push(tag, attributes)

    def read(self, page: str) -> None:
        at = 0
        while at < len(page):
            m = TOKEN.match(page, at)
            at, tag = m.end(), m[2]
            if tag is None:
                text = m[0]
                if text[0] != "<" or text == "<":
                    self.add(html.unescape(text) if "&" in text else text)
                continue
            tag = tag.lower()
            if m[1]:
                self.end(tag)
            elif tag in RAW:
                if not m[3].endswith("/") or tag not in ("svg", "math"):
                    end = RAW_END[tag].search(page, at)
                    at = end.end() if end else len(page)
                if tag not in ("svg", "math"):
                    self.add(" ")
            else:
                self.begin(tag, m[3])
        self.flush()


def content_blocks(page: str) -> list[tuple[str, int]]:
    """Blocks of a page in order, each MAIN or ASIDE.

    Elements that tags, names or roles call chrome go, but a page is not emptied by names: where nothing else is in an
    article or main element, one that is all of the text, or most of it in several blocks, stays as ASIDE, and the pages
    beside it have to tell. ASIDE too is what stands outside the article and main elements of a page that has such text, and
    what inside them has a name that may tell of its subject (UNSURE_NAMES): only repetition makes it boilerplate.
    """
    reader = PageReader(page)
    free = [(text, zone) for text, zone, mark, _ in reader.blocks if mark < 0]
    zoned = any(zone for _, zone in free)
    contested: set[int] = set()
    if not zoned:
        sizes, blocks = defaultdict(int), defaultdict(int)
        for text, _, mark, _ in reader.blocks:
            sizes[mark] += len(text)
            blocks[mark] += 1
        rest = sizes.pop(-1, 0)
        most = max(sizes, key=lambda k: (sizes[k], -k), default=-1)
        if most >= 0 and (not rest or (sizes[most] > rest and blocks[most] > 1 and not reader.maybe[most].comments)):
            contested.add(most)
    out = []
    for text, zone, mark, unsure in reader.blocks:
        if mark < 0:
            out.append((text, MAIN if not unsure and (zone or not zoned) else ASIDE))
        elif mark in contested:
            out.append((text, ASIDE))
    return out


class TokenHashes(dict):
    """31-bit hashes of tokens, doubled, worked out when first asked for."""

    def __init__(self, length: int, most: int = 300_000) -> None:
        import xxhash

        self.hash, self.length, self.most = xxhash.xxh32_intdigest, length, most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[token] = self.hash(token.encode("utf-8", "surrogatepass")) & ~1
        return value

    def of(self, text: str, places: list[int]) -> np.ndarray:
        """Hashes of the tokens of a page's blocks, with the block's place in the lowest bit.

        A block shorter than a run stands between signs that fill it up to one, so it is a run as a whole.
        """
        words = [block.split(" ") for block in text.split("\n")] if text else []
        filled = [w if len(w) >= self.length else [BEGIN, *w, *[END] * (self.length - 1 - len(w))] for w in words]
        sizes = list(map(len, filled))
        found = np.fromiter((self[w] for own in filled for w in own), dtype=np.uint32, count=sum(sizes))
        return found | np.repeat(np.array(places, dtype=np.uint32), sizes)


#: No tokens of a text, which have no white space.
BEGIN, END = "\n", "\n\n"


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (struct of the page's columns, html) to (the same, blocks joined by line feeds, their places)."""
    for keys, pages in grouped_texts(batches):
        found = [content_blocks(page) for page in pages.to_pylist()]
        columns = [pa.array([k[n] for k in keys], t) for n, t in (("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()))]
        columns += [pa.array(["\n".join(t for t, _ in blocks) for blocks in found], pa.string())]
        columns += [pa.array([[place for _, place in blocks] for blocks in found], pa.list_(pa.int8()))]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "text", "places"])


def token_streams(length: int):
    """For mapInArrow: (host, shards, shard, text, places) to (host, shards, shard, hashes of the page's tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes(length)
        for batch in batches:
            tokens = [hashes.of(t, p).tobytes() for t, p in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True)]
            names = ["host", "shards", "shard"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(tokens, pa.binary())], names=[*names, "tokens"])

    return run


def run_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` tokens at each place that has so many."""
    total = np.zeros(max(0, len(tokens) - length + 1), dtype=np.uint64)
    for i in range(length):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + len(total)].astype(np.uint64))
    return total.view(np.int64)


def repeated_suffixes(tokens: np.ndarray, pages: np.ndarray, length: int, least_pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of `length` tokens that least_pages distinct pages hold, and how many pages hold each.

    A suffix array of the concatenated pages by prefix doubling, to the depth that counts: suffixes are ranked by their
    first 1, 2, 4 ... tokens, and those alone in their rank leave, for nothing repeats them.
    """
    n = len(tokens)
    stop = np.searchsorted(pages, pages, side="right")
    depth, at, key = 1, np.arange(n), tokens
    alive, rank = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    while True:
        _, group, size = np.unique(key, return_inverse=True, return_counts=True)
        keep = size[group] >= least_pages
        at, group = at[keep], group[keep]
        if depth == length or not len(at):
            break
        alive[:] = False
        alive[at], rank[at] = True, group
        step = min(depth, length - depth)
        depth += step
        at = at[at + depth <= stop[at]]
        at = at[alive[at + step]]
        key = rank[at] * np.int64(n + 1) + rank[at + step]
    if not len(at):
        return at, at
    order = np.lexsort((pages[at], group))
    g, p = group[order], pages[at][order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])])
    held = np.bincount(g[new])[group]
    return at[held >= least_pages], held[held >= least_pages]


def run_places(tokens: np.ndarray, length: int) -> np.ndarray:
    """The place of each run: ASIDE if all of its tokens are, else MAIN."""
    place = np.ones(max(0, len(tokens) - length + 1), dtype=np.int64)
    for i in range(length):
        place &= (tokens[i : i + len(place)] & 1).astype(np.int64)
    return place


def shared_runs(length: int, least_pages: int, shares: tuple[float, float]):
    """For applyInArrow: hashes of the runs that reach their place's share of a shard's pages.

    A run that reaches a share of a host's pages reaches it in one of the host's shards at least, so none is missed; those
    of hosts in several shards are counted over all of them afterwards.
    """

    def run(table: pa.Table) -> pa.Table:
        pages = [np.frombuffer(t, dtype=np.uint32) for t in table.column("tokens").to_pylist()]
        shards = table.column("shards")[0].as_py()
        needed = np.array([max(least_pages if shards == 1 else 1, int(np.ceil(s * len(pages)))) for s in shares])
        found: list[tuple[int, int]] = []
        if len(pages) >= needed.min():
            tokens = np.concatenate([*pages, np.empty(0, dtype=np.uint32)])
            number = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
            at, held = repeated_suffixes((tokens >> 1).astype(np.int64), number, length, int(needed.min()))
            place = run_places(tokens, length)[at]
            enough = held >= needed[place]
            found = sorted(set(zip(run_hashes(tokens, length)[at[enough]].tolist(), place[enough].tolist(), strict=True)))
        runs, places = zip(*found, strict=True) if found else ((), ())
        columns = [pa.array([table.column("host")[0].as_py()] * len(found), pa.string()), pa.array(runs, pa.int64()), pa.array(places, pa.int32())]
        return pa.table([*columns, pa.array([shards > 1] * len(found), pa.bool_())], names=["host", "run", "place", "open"])

    return run


def held_runs(length: int):
    """For mapInArrow: (host, text, places, runs) to (host, run), once for each of the runs that a page holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes(length)
        for batch in batches:
            hosts, held = [], []
            for host, text, places, runs in zip(*(batch.column(n).to_pylist() for n in ("host", "text", "places")), batch.column("runs"), strict=True):
                own = np.intersect1d(run_hashes(hashes.of(text, places), length), runs.values.to_numpy())
                hosts += [host] * len(own)
                held.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(np.concatenate([*held, np.empty(0, dtype=np.int64)]))], names=["host", "run"])

    return run


def without_runs(text: str, tokens: np.ndarray, verdicts: list[np.ndarray], length: int) -> str:
    """text without the tokens that runs of the verdicts for their place cover; the main text stays if all of it would go."""
    runs, place = run_hashes(tokens, length), run_places(tokens, length)
    edge = np.zeros(len(tokens) + 1, dtype=np.int64)
    for p in (MAIN, ASIDE):
        hit = np.flatnonzero((place == p) & np.isin(runs, verdicts[p]))
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    if not gone.any():
        return text
    main = (tokens & 1) == MAIN
    if main.any() and gone[main].all():
        gone &= ~main
    out, at = [], 0
    for block in text.split("\n"):
        words = block.split(" ")
        short = len(words) < length
        out.append(" ".join(w for w, g in zip(words, gone[at + short : at + short + len(words)].tolist(), strict=True) if not g))
        at += max(len(words), length)
    return "\n".join(b for b in out if b)


def drop_runs(length: int):
    """For mapInArrow: (page_id, url, text, places, runs by place) to (page_id, url, text) without those runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, hashes = np.empty(0, dtype=np.int64), TokenHashes(length)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lists = [batch.column("main_runs"), batch.column("aside_runs")]
            for i, places in enumerate(batch.column("places")):
                verdicts = [c[i].values.to_numpy() if c[i].is_valid else none for c in lists]
                if any(map(len, verdicts)):
                    texts[i] = without_runs(texts[i], hashes.of(texts[i], places.as_py()), verdicts, length)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def boilerplate(pages: DataFrame, scratch: Scratch, length: int, least_pages: int, shares: tuple[float, float], shard_pages: int) -> DataFrame:
    """(host, main_runs, aside_runs): the runs of each host that are boilerplate in either place.

    A host has at most 1 / share times its mean page length of them.
    """
    # Written tables have a known size, by which Spark picks the joins before it shuffles any text.
    sizes = scratch.keep(pages.groupBy("host").agg(F.count("*").alias("pages")).withColumn("shards", F.ceil(F.col("pages") / shard_pages)), "sizes")
    # The rows of a written table have the same numbers whenever a lost task is run again.
    dealt = pages.select("host", "text", "places", F.monotonically_increasing_id().alias("row")).join(sizes, "host")
    dealt = dealt.select("host", "shards", F.pmod(F.xxhash64("row"), "shards").alias("shard"), "text", "places")
    streams = dealt.mapInArrow(token_streams(length), "host string, shards long, shard long, tokens binary")
    runs = streams.groupBy("host", "shard").applyInArrow(shared_runs(length, least_pages, shares), "host string, run long, place int, open boolean")
    runs = scratch.keep(runs.distinct(), "runs")
    waiting = runs.where("open").groupBy("host").agg(F.collect_set("run").alias("runs"))
    held = pages.select("host", "text", "places").join(scratch.keep(waiting, "waiting"), "host").mapInArrow(held_runs(length), "host string, run long")
    counts = held.groupBy("host", "run").agg(F.count("*").alias("held")).join(sizes, "host")
    share = F.when(F.col("place") == MAIN, F.lit(shares[MAIN])).otherwise(F.lit(shares[ASIDE]))
    counted = runs.where("open").join(counts, ["host", "run"]).where(F.col("held") >= F.greatest(F.lit(least_pages), F.ceil(share * F.col("pages"))))
    verdicts = runs.where("NOT open").select("host", "run", "place").union(counted.select("host", "run", "place"))
    of_place = [F.collect_list(F.when(F.col("place") == p, F.col("run"))).alias(name) for p, name in ((MAIN, "main_runs"), (ASIDE, "aside_runs"))]
    return scratch.keep(verdicts.groupBy("host").agg(*of_place), "verdicts")


def main_text(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    run_length: int = 8,
    least_pages: int = 3,
    main_share: float = 0.5,
    aside_share: float = 0.01,
    shard_pages: int = 400,
) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of pages.

    Elements that are no article text by tag, name, role or visibility go; what that leaves open (`content_blocks`) the
    pages of the host decide. Their token streams are concatenated, and a suffix array finds the runs of run_length tokens
    that repeat over distinct pages (a shorter block counts as a run): boilerplate is what least_pages pages and a share of the host's pages hold, main_share
    of them inside the main text and aside_share beside it. Covered tokens go, unique runs stay. The main text of a page
    stays if all of it would go, for no page is boilerplate alone.

    Suffix arrays are built over random shards of about shard_pages pages of a host; runs that reach the share in a shard
    are then counted over all of its pages, so the verdicts are those of the whole host, whatever the shards.

    Null or empty html: empty text. Null url, or one without a host: the page stands alone. Repeated rows: pages of their
    own. Hosts of fewer than least_pages pages: structure alone decides. Empty table: empty result. Other columns do not
    matter.
    """
    scratch = Scratch(pages.sparkSession, "host-pages")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    # A page without a host has a group of its own.
    alone = F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))
    keyed = source.select(F.struct("page_id", "url", F.when(host != "", host).otherwise(alone).alias("host")).alias("key"), "html")
    parsed = scratch.keep(keyed.mapInArrow(parse, "page_id long, url string, host string, text string, places array<tinyint>"), "parsed")
    verdicts = boilerplate(parsed, scratch, run_length, least_pages, (main_share, aside_share), shard_pages)
    joined = parsed.join(verdicts, "host", "left").select("page_id", "url", "text", "places", "main_runs", "aside_runs")
    cleaned = joined.mapInArrow(drop_runs(run_length), "page_id long, url string, text string")
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint"))
