"""Main text of web pages: differencing each page with the pages nearest by URL finds the element that holds it."""

import bisect
import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import cut, scratch, small, table

# What the scanner knows of markup: elements without text, elements that part blocks, elements, roles and
# names (parts of a class or id) of what isn't the article, and elements that hold the article.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
#: One attribute after the other, so that what stands inside a quoted value is no attribute.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
DIGIT = re.compile(r"\d")
MARKING = {"class", "id", "role", "hidden", "aria-hidden"}
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead tr ul".split())
NOT_TEXT = set("aside button dialog fieldset footer form head label menu nav option search select".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
HEADERS = {"header", "hgroup", "topbar"}
#: What a name inside an article may also hold and still be one of NAMES: the box around it.
BOXES = set("area bar block box buttons container group inline item items label links list panel section slot top bottom unit wrap wrapper".split())
ARTICLES = ("article", "main")
#: Elements that may hold an article: what parts blocks and is neither a whole page nor a block of text.
HOLDERS = BLOCKS - set("html head body p li dt dd option h1 h2 h3 h4 h5 h6 hr pre legend summary figcaption address tr".split())
#: Partners of a page on either side of it.
STEPS = 2
#: Pages in a row that are compared by one task.
CHUNK = 256
#: Elements that end at the next tag of their own kind, and what else ends them.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}


def _marks(attributes: str) -> tuple[set[str], bool, str, bool]:
    """Parts of the classes and id, whether one of these is wholly made of NAMES and BOXES, the role, and whether the element is hidden."""
    names, wholly, role, hidden = set(), False, "", False
    for key, value in ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key not in MARKING:
            continue
        value = html.unescape(value.strip("\"'")).lower()
        if key in ("class", "id"):
            for name in value.split():
                found = {x for x in re.split(r"[_-]+", name) if x}
                names |= found
                wholly = wholly or bool(found & NAMES and found <= NAMES | BOXES)
        elif key == "role":
            role = value
        else:
            hidden = hidden or key == "hidden" or value == "true"
    return names, wholly, role, hidden


def lines(page: str | None) -> tuple[list[tuple[str, int, bool]], list[list[int]]]:
    """The page's blocks in order: (text, number of the article element around it or 0, whether it is chrome). And its holders: (path, first block, the block after its last).

    One pass over the tags. An end tag closes up to its element, if that is open; character references are decoded and
    white space becomes single spaces. Chrome is what markup itself declares to be a menu, header, footer,
    sidebar, notice, advert, form or comment, or hidden; inside an article a class or id says so only as a whole, not by one of its words.
    A path is a hash of the holders around an element and itself, by element, class and id without parts that have digits.
    """
    found: list[tuple[str, int, bool]] = []
    holders: list[list[int]] = []
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, -1)]  # element, article, chrome, holder
    text: list[str] = []
    articles = 0

    def end_block() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                found.append((block, stack[-1][1], stack[-1][2]))

    page, at = page or "", 0
    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            text.append(" ")
        if name in BLOCKS:
            end_block()
        elif name in ("td", "th"):
            text.append(" ")
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                if any(x[2] != stack[depth - 1][2] or x[1] != stack[depth - 1][1] for x in stack[depth:]):
                    end_block()
                for held in {x[3] for x in stack[depth:]} - {stack[depth - 1][3]}:
                    holders[held][2] = len(found)
                del stack[depth:]
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in VOID:
            continue
        while stack[-1][0] in CLOSES and name in CLOSES[stack[-1][0]]:
            stack.pop()
        _, article, chrome, holder = stack[-1]
        names, wholly, role, hidden = _marks(m[3]) if m[3] else (set(), False, "", False)
        if not article and not chrome and (name in ARTICLES or role == "main"):
            articles += 1
            article = articles
        header = (name in HEADERS or bool(names & HEADERS)) and not article
        # Names of the article element and the body itself are of themes, not of roles.
        named = (wholly if article else bool(names & NAMES)) and name not in ("html", "body", *ARTICLES) or (name == "article" and "comment" in names)
        chrome_now = chrome or name in NOT_TEXT or role in ROLES or named or header or hidden
        if chrome_now != chrome or article != stack[-1][1]:
            end_block()
        if name in HOLDERS:
            path = line_hash(f"{holders[holder][0] if holder >= 0 else 0} {name} {' '.join(sorted(x for x in names if not DIGIT.search(x)))}")
            holder = len(holders)
            holders.append([path, len(found), -1])
        stack.append((name, article, chrome_now, holder))
    end_block()
    for held in holders:
        held[2] = len(found) if held[2] < 0 else held[2]
    return found, [x for x in holders if x[1] < x[2]]


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def common_lines(one: list[int], other: list[int]) -> set[int]:
    """Places in `one` of a longest common subsequence of the two: a longest rising chain of matches."""
    places: dict[int, list[int]] = {}
    for j, h in enumerate(other):
        places.setdefault(h, []).append(j)
    ends: list[int] = []
    chain: list[tuple[int, object]] = []
    for i, h in enumerate(one):
        for j in reversed(places.get(h, ())):
            k = bisect.bisect_left(ends, j)
            node = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(node)
            else:
                ends[k], chain[k] = j, node
    found, node = set(), chain[-1] if chain else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def content(page: str | None) -> tuple[list[str], list[int], list[int], list[int], list[int], list[int], list[int], list[int], list[int]]:
    """A page: (blocks, their places, places inside article elements, hashes of all lines, their sizes, less than 0 for chrome, candidates; paths, first and last places of its holders).

    Blocks are all that aren't chrome by markup. Candidates are the places that go if most partners share them: blocks outside article elements. What stands in an article
    is content, as the page itself says, even if another page has it too, unless differencing finds the content in another element.
    """
    found, holders = lines(page)
    places = [i for i, b in enumerate(found) if not b[2]]
    inside = [i for i in places if found[i][1]]
    candidates = [i for i in places if not found[i][1]]
    sizes = [-len(b) if c else len(b) for b, _, c in found]
    return [found[i][0] for i in places], places, inside, [line_hash(b[0]) for b in found], sizes, candidates, *([x[k] for x in holders] for k in range(3))


def main_text(page: str | None) -> str:
    """The text of a page without a partner: its article elements, or all blocks if it has none."""
    blocks, places, inside, *_ = content(page)
    return "\n\n".join(b for b, i in zip(blocks, places, strict=True) if not inside or i in inside)


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return "", url or ""
    return parts.netloc.lower(), f"{parts.path}?{parts.query}"


def near_copy(hashes: list[int], sizes: list[int], other: list[int]) -> bool:
    """Whether the other page shares over half of the page's text that isn't chrome."""
    return _most(sizes, common_lines(hashes, other))


def _most(sizes: list[int], common: set[int]) -> bool:
    return 2 * sum(sizes[i] for i in common if sizes[i] > 0) > sum(x for x in sizes if x > 0)


class Judge:
    """Compares pages with partners: rows of pairs that bear on single lines, and sums for each holder's path over the pairs that aren't near copies.

    Sums of a path, over pages that have it: pairs, elements, blocks in them, all the page's blocks, the characters in them that the partner doesn't share, and those of the page; the blocks in them that it shares.
    """

    PAIRS = "at long, step int, to long, host string, near boolean, shared array<int>"
    SUMS = "path long, pairs long, elements long, blocks long, all_blocks long, differs long, all_differs long, shared_blocks long"

    def __init__(self, ids: pa.DataType):
        self.sums: dict[tuple[str, int], list[int]] = {}
        listed = pa.list_(pa.int32())
        fields = [("id", ids), ("t", pa.int64()), ("at", pa.int64()), ("step", pa.int32()), ("to", pa.int64()), ("host", pa.string()), ("near", pa.bool_()), ("shared", listed)]
        self.schema = pa.schema([*fields, *((x.split()[0], pa.int64()) for x in self.SUMS.split(", "))])

    def pair(self, page: dict, other: list[int]) -> tuple[bool, list[int]]:
        """(whether the other page is a near copy, the candidates that it shares)."""
        sizes, common = page["sizes"], common_lines(page["lines"], other)
        if _most(sizes, common):
            return True, []
        differs, blocks = [0], [0]
        for i, size in enumerate(sizes):
            differs.append(differs[-1] + (0 if i in common else abs(size)))
            blocks.append(blocks[-1] + (i in common))
        met: set[int] = set()
        for path, first, after in zip(page["paths"], page["firsts"], page["afters"], strict=True):
            sums = self.sums.setdefault((page["host"], path), [0] * 7)
            if path not in met:
                met.add(path)
                sums[0] += 1
                sums[3] += len(sizes)
                sums[5] += differs[-1]
            sums[1] += 1
            sums[2] += after - first
            sums[4] += differs[after] - differs[first]
            sums[6] += blocks[after] - blocks[first]
        return False, [i for i in page["candidates"] if i in common]

    def pairs(self, rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array([r[i] for r in rows], f.type) if i < 8 else pa.nulls(len(rows), f.type) for i, f in enumerate(self.schema)], self.schema)

    def summed(self) -> pa.Table:
        """The sums so far, which start anew."""
        rows, self.sums = [(host, path, *x) for (host, path), x in self.sums.items()], {}
        columns = [pa.nulls(len(rows), f.type) if i < 8 and f.name != "host" else pa.array([r[0 if f.name == "host" else i - 7] for r in rows], f.type) for i, f in enumerate(self.schema)]
        return pa.table(columns, self.schema)


def _runs(at: DataFrame, hosts: DataFrame) -> DataFrame:
    """(to, first, after) of the pages of the hosts: where the run of near copies around a page starts, and the next run.

    A run is a stretch of pages of which each is a near copy of the next, or the next of it.
    """
    pages = at.join(hosts, "host", "left_semi").select("part", "at", "host", "lines", "sizes")
    ahead = pages.select((F.col("at") + 1).alias("at"), "host", F.col("lines").alias("p_lines"), F.col("sizes").alias("p_sizes"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)
            linked = pa.array([near_copy(a, m, b) or near_copy(b, n, a) for a, m, b, n in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(linked)], ["at"])

    linked = pages.join(ahead, ["at", "host"]).select("at", "lines", "sizes", "p_lines", "p_sizes").mapInArrow(link, "at long").withColumn("_linked", F.lit(True))
    marked = cut(pages.select("part", "at").join(linked, "at", "left").select("part", "at", F.when(F.col("_linked").isNull(), F.col("at")).alias("start")))
    # Starts are carried from part to part; a part's pages are those of a range-sorted task.
    ends = marked.groupBy("part").agg(F.max("start").alias("_max"), F.min("start").alias("_min"), F.max("at").alias("_last"))
    # What follows is read backwards: a frame that ends at the last row would be worked out anew for each row.
    before, back = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("part"))
    behind = F.coalesce(F.min("_min").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.max("_last").over(back.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    carried = ends.select("part", F.max("_max").over(before).alias("_first"), behind.alias("_after"))
    within = Window.partitionBy("part")
    first = F.max("start").over(within.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    after = F.min("start").over(within.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1))
    return marked.select("part", F.col("at").alias("to"), first.alias("first"), after.alias("after")).join(F.broadcast(carried), "part").select("to", F.coalesce("first", "_first").alias("first"), F.coalesce("after", "_after").alias("after"))


def parse(pages: DataFrame) -> DataFrame:
    """id, url, t, host, path and what `content` says of each row of (id, url, t, html)."""
    text, short, long = (pa.list_(x) for x in (pa.string(), pa.int32(), pa.int64()))
    kinds = (text, short, short, long, short, short, long, short, short)
    names = ["blocks", "places", "inside", "lines", "sizes", "candidates", "paths", "firsts", "afters"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, done = [_place(u) for u in batch.column(1).to_pylist()], [content(page) for page in batch.column(3).to_pylist()]
            columns = [*batch.columns[:3], *[pa.array([k[i] for k in known], pa.string()) for i in (0, 1)], *[pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "url", "t", "host", "path", *names])

    kind = pages.schema["id"].dataType.simpleString()
    return pages.mapInArrow(run, f"id {kind}, url string, t long, host string, path string, blocks array<string>, places array<int>, inside array<int>, lines array<long>, sizes array<int>, candidates array<int>, paths array<long>, firsts array<int>, afters array<int>")


def differences(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What differencing with near pages finds: (id, t, gone), the places of each page that go because more than half of its partners share them, pages without such places
    left out; and (host, holding, whole), the paths of the elements that hold what differs between the host's pages, and those of them that lose no line.

    Partners are the pages next to it in URL order on its host, STEPS to either side: what one neighbour has too may be a sentence that articles share, what most of them have is the
    host's. Near copies are passed over: the search goes on at twice the distance, or at the end of the run of near copies if that
    is nearer. Pages are numbered by a range sort, so a host may span any number of tasks; neighbours meet in chunks of numbers, each with the few pages next to it.

    An element holds what differs if, over the host's pages that have it, over three quarters of what differs is in it, it has two blocks or more on average, and leaves out a block of each page. If fewer than
    one in ten of its blocks are shared, these are sentences that articles have in common, and it loses none.
    """
    data = ["lines", "sizes", "candidates", "paths", "firsts", "afters"]
    ordered = parsed.select("id", "t", "host", "path", *data).repartitionByRange("host", "path", "id", "t").sortWithinPartitions("host", "path", "id", "t").drop("path")
    numbered = cut(ordered.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = numbered.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    at = numbered.join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.col("nth"))

    def neighbours(key: tuple, chunk: pa.Table) -> pa.Table:
        judge, found = Judge(chunk.schema.field("id").type), []
        pages = {x["at"]: x for x in chunk.to_pylist()}
        for n, page in pages.items():
            if n // CHUNK != key[0].as_py():
                continue
            others = {k: pages[n + k] for j in range(1, STEPS + 1) for k in (-j, j) if n + k in pages and pages[n + k]["host"] == page["host"]}
            judged = {k: judge.pair(page, x["lines"]) for k, x in others.items()}
            # Pairs that say nothing of any line need no row; all of a page's are counted if one does.
            if page["candidates"] and any(near or shared for near, shared in judged.values()):
                found += [(page["id"], page["t"], n, k, n + k, page["host"], near, shared) for k, (near, shared) in judged.items()]
            else:
                found += [(page["id"], page["t"], n, k, n + k, page["host"], True, []) for k, (near, _) in judged.items() if near]
        return pa.concat_tables([judge.pairs(found), judge.summed()])

    def further_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = None
        for batch in batches:
            judge = judge or Judge(batch.schema.field("id").type)
            found = [(*(x[c] for c in ("id", "t", "at", "step", "to", "host")), *judge.pair(x, x["p_lines"])) for x in batch.to_pylist()]
            yield from judge.pairs(found).to_batches()
        if judge:
            yield from judge.summed().to_batches()

    schema = f"id {parsed.schema['id'].dataType.simpleString()}, t long, {Judge.PAIRS}, {Judge.SUMS}"
    pages = at.select("id", "t", "host", "at", *data)
    own, nth = F.floor(F.col("at") / CHUNK), F.col("at") % CHUNK
    chunks = F.array_compact(F.array(own, F.when(nth < STEPS, own - 1), F.when(nth >= CHUNK - STEPS, own + 1)))
    judged = cut(pages.withColumn("chunk", F.explode(chunks)).groupBy("chunk").applyInArrow(neighbours, schema))
    others = at.select(F.col("at").alias("to"), "host", F.col("lines").alias("p_lines"))
    every, near, runs = judged, judged.where("near"), None
    while not near.isEmpty():
        runs = cut(_runs(at, near.select("host").distinct())) if runs is None else runs
        further = F.when(F.col("step") > 0, F.least(2 * F.col("to") - F.col("at"), F.col("after"))).otherwise(F.greatest(2 * F.col("to") - F.col("at"), F.col("first") - 1))
        waiting = near.select("at", "step", "to").join(runs, "to").withColumn("to", further).select("at", "step", "to").join(pages, "at")
        judged = cut(waiting.join(others, ["to", "host"]).mapInArrow(further_off, schema))
        every, near = every.unionByName(judged), judged.where("near")
    # Equal rows have one page between them, whose partners are those of all. A partner that two searches ended at has one vote.
    right = every.where("not near and path is null")
    votes = right.groupBy("id", "t").agg(F.collect_set(F.struct("to", "shared")).alias("votes"))
    places = F.array_distinct(F.flatten("votes.shared"))
    most = F.filter(places, lambda place: 2 * F.size(F.filter("votes", lambda v: F.array_contains(v["shared"], place))) > F.size("votes"))
    gone = votes.select("id", "t", most.alias("gone")).where(F.size("gone") > 0)
    summed = every.where("path is not null").groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("pairs", "elements", "blocks", "all_blocks", "differs", "all_differs", "shared_blocks")])
    holding = summed.where("4 * differs > 3 * all_differs and blocks >= 2 * elements and all_blocks - blocks >= pairs")
    return gone, holding.groupBy("host").agg(F.collect_list("path").alias("holding"), F.collect_list(F.expr("CASE WHEN 10 * shared_blocks < blocks THEN path END")).alias("whole"))


def holding_spans() -> Column:
    """(first, after) of the page's elements of the path that holds what differs on its host; of several such paths, the one with the fewest blocks, the innermost."""
    spans = F.filter(F.arrays_zip("paths", "firsts", "afters"), lambda x: F.array_contains("holding", x["paths"]))
    size = lambda path: F.aggregate(F.filter(spans, lambda x: x["paths"] == path), F.lit(0), lambda n, x: n + x["afters"] - x["firsts"])
    innermost = F.array_min(F.transform(F.array_distinct(F.transform(spans, lambda x: x["paths"])), lambda path: F.struct(size(path).alias("n"), path.alias("path"))))
    return F.filter(spans, lambda x: x["paths"] == innermost["path"])


def _within(place: Column, spans: Column) -> Column:
    return F.exists(spans, lambda x: (x["firsts"] <= place) & (place < x["afters"]))


def kept_places() -> Column:
    """Places of the page's text before shared lines go."""
    held = F.filter("places", lambda i: _within(i, F.col("spans")))
    size = lambda places: F.aggregate(places, F.lit(0), lambda n, i: n + F.get("sizes", i))
    elsewhere = (F.size(F.array_intersect(held, "inside")) == 0) & (size(held) > size(F.col("inside")))
    return F.when(F.size("inside") == 0, F.col("places")).when(F.coalesce(elsewhere, F.lit(False)), held).otherwise(F.col("inside"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text.

    A null or empty page has an empty text, pages of any length are taken whole; a null or broken URL is a host of its own; rows of equal id
    are told apart by URL and page, equal rows get equal texts; ids of any type may be null; other columns are ignored; an empty table gives an empty
    result. A page of which partners share every line keeps its lines.

    Differencing says which element holds the page's content. Markup then says where the article ends: if article elements lie inside it or around it, they are the text, whole. If they lie elsewhere and have less
    text (teasers beside a story), the element is the text, without chrome and lines that most partners share. A page without article elements is all that isn't chrome nor, outside the element, a line that most partners share. A page for
    which no element is found has its article elements.

    Pages are parsed once, to a table in the shared folder; only hashes and sizes of lines go to partners, and texts
    are shuffled only where the pages that lose lines, or the hosts, are too many to be broadcast.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(url_col, html_col).alias("t"), F.col(html_col).alias("html"))
    path = scratch(spark, "pages")
    parse(rows).write.option("compression", "zstd").parquet(path)
    parsed = spark.read.parquet(path)
    gone, holding = (small(cut(x)) for x in differences(parsed))
    gone = gone.withColumnsRenamed({"id": "_id", "t": "_t"})
    whole = parsed.select("id", "url", "t", "host", "blocks", "places", "inside", "sizes", "paths", "firsts", "afters")
    joined = whole.join(gone, F.equal_null("id", "_id") & (F.col("t") == F.col("_t")), "left").join(holding, "host", "left").withColumn("spans", holding_spans()).withColumn("kept", kept_places())
    safe = F.filter("spans", lambda x: F.array_contains("whole", x["paths"]))
    left = F.filter("kept", lambda i: ~F.array_contains("gone", i) | F.coalesce(_within(i, safe), F.lit(False)))
    shown = F.when(F.col("gone").isNull() | (F.size(left) == 0), F.col("kept")).otherwise(left)
    text = F.array_join(F.filter("blocks", lambda b, i: F.array_contains(shown, F.get("places", i))), "\n\n")
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"))


def op6_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
