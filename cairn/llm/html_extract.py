"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines, one for each block.  A line's slot is the path of its
elements with their class and id; its key is slot and text.  Pages are ordered by
URL path within their host, and every page is compared with the ``SIDE`` nearest
pages before and behind it; those whose path shares the most leading segments are
its partners.  Two alignments by longest common subsequence decide what is furniture:

* by key: a line that at least half of the partners share;
* by slot: a line that is mostly links, or the only text of a bare container
  (no paragraph, heading, list item or cell), and stands in the same slot on all
  neighbours, so a menu whose words differ from page to page goes too.

Differencing alone cannot give right results: passages that several articles quote
are shared but are text, and a page may have no neighbour.  So the page's own marks
have the rest: lines inside an article or main element stay even if shared, and
lines that no alignment decides go if they lie in navigation, headers, footers,
asides, forms, adverts, notices or reader comments.

Versions of one story (equal title and first heading; without both, equal lines)
are no neighbours of each other and count once as neighbours of others, so an
article at many addresses is not its own furniture.

Pages are dealt into ranges of host, path and id of about ``BUCKET`` pages, at most ``RANGES``
ranges, whose bounds come from a sample of keys of that size on the driver;
bounds only decide where a page is worked on.  A first pass takes each range's
outermost stories, and these are joined to the ranges beside it, so a page finds
its nearest URLs on a host of any size and behind any run of versions.

Defined cases: a null or empty page has no text; a null URL pairs with other null
URLs; repeated rows are pages of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left, bisect_right
from itertools import count, groupby, takewhile

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import materialise, shuffle_width

#: Pages of a range at most, and at least if there are enough tasks; both roughly.
BUCKET, LEAST = 2_000, 256
#: Keys that are sampled for each range bound, and ranges at most: bounds the keys that the driver sorts.
SAMPLE, RANGES = 20, 20_000
#: Neighbours on each side, each of another story.
SIDE = 2
#: Rows of an alignment between two that are kept for its way back.
KEPT_ROWS = 256

FURNITURE, OPEN, MAIN = 0, 1, 2
PROSE, BARE, LINKS = 0, 1, 2

# Element and attribute names of HTML, and usual class names of furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("head title nav footer aside form button select option textarea noscript template iframe svg canvas object audio video menu dialog map datalist".split())
RAW = frozenset("script style textarea title noscript iframe svg template xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
MARKS = frozenset(
    "ad ads adbox adslot adunit advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices"
    " popup modal overlay newsletter subscribe subscription signup sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer comment comments"
    " commentlist disqus respond reply replies share sharing social related recommended login search skip pagination pager toolbar masthead".split()
)
ARTICLE_MARKS = frozenset("ad ads advert advertisement sponsored promo comment comments reply related recommended".split())
PROSE_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption address".split())
PAIRED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table select body html article main section div nav header footer aside form".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)
_WORD = re.compile(r"[^a-z0-9]+")
_NUMBER = re.compile(r"[0-9]+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _decide(name: str, raw: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether it is the main text."""
    if name in DROPPED or (name == "header" and not in_main):
        return True, False
    main = name in ("article", "main")
    if not raw or raw.isspace() or name in ("html", "body", "main"):  # a page's class names tell its layout
        return False, main
    marks = ARTICLE_MARKS if name == "article" else MARKS
    a = _attributes(raw)
    role = a.get("role", "").strip().lower()
    if role in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True, False
    for value in (a.get("class", ""), a.get("id", "")):
        for token in value.lower().split():
            parts = _WORD.split(token)
            if token in marks or parts[0] in marks or parts[-1] in marks or (not in_main and name != "article" and "header" in (parts[0], parts[-1])):
                return True, False
    return False, main or role == "main" or a.get("itemprop", "").lower() == "articlebody"


def _hash(line: str) -> int:
    x = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def _slot(above: int, name: str, raw: str) -> int:
    """The slot of an element below ``above``: names, classes and ids, numbers alike."""
    own = name
    if raw and not raw.isspace():
        a = _attributes(raw)
        own = f"{name}.{a.get('class', '')}#{_NUMBER.sub('0', a.get('id', ''))}"
    return xxhash.xxh32_intdigest(f"{above}/{own}".encode("utf-8", "surrogatepass")) >> 1


class Scanner:
    """The tokens of a page, each character being looked at a bounded number of times.

    A tag ends at the first ``>`` outside quotes or, where a quote stays open, at the first ``>`` at all.  A
    scan that ran into an open quote leaves the quotes it passed behind, so that no later one follows it again.
    """

    def __init__(self, page: str):
        self.page = page
        self.open: set[int] = set()
        self.absent: set[str] = set()
        self.last = page.rfind(">")

    def _find(self, what: str, at: int) -> int:
        """As ``find``, but what is not there any more is not looked for again."""
        if what in self.absent:
            return -1
        if (found := self.page.find(what, at)) < 0:
            self.absent.add(what)
        return found

    def _tag_end(self, at: int) -> int:
        """Where the ``>`` stands that ends a tag whose attributes begin at ``at``."""
        passed, begin = [], at
        while (stop := _STOP.search(self.page, at)) is not None:
            if stop[0] == ">":
                return stop.start()
            passed.append(stop.start())
            if stop.start() in self.open or (close := self._find(stop[0], stop.end())) < 0:
                break
            at = close + 1
        self.open.update(passed)
        return self.page.find(">", begin)

    def tokens(self):
        """``start, end, closing, name, attributes``; comments and the like have no name, CDATA its text as attributes."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = self._find("-->", start + 4)
                at = end + 3 if end >= 0 else len(page)
                yield start, at, "", "", None
            elif start >= self.last:
                at = start + 1
            elif page.startswith("<![CDATA[", start) and (end := self._find("]]>", start + 9)) >= 0:
                at = end + 3
                yield start, at, "", "", page[start + 9 : end]
            elif page[start + 1] in "!?":
                at = page.find(">", start) + 1
                yield start, at, "", "", None
            elif (tag := _TAG.match(page, start)) is not None and tag.end() <= self.last:
                end = self._tag_end(tag.end())
                at = end + 1
                jump = yield start, at, tag[1], tag[2].lower(), page[tag.end() : end]
                if jump is not None:
                    at = jump
                    yield
            else:
                at = start + 1

    def behind(self, name: str, at: int) -> tuple[int, int] | None:
        """Where the closing tag of a raw element begins and ends."""
        if name in self.absent:
            return None
        close = re.compile(rf"</{re.escape(name)}\b", re.I).search(self.page, at)
        end = self.page.find(">", close.end()) if close is not None and close.end() <= self.last else -1
        if end < 0:
            self.absent.add(name)
            return None
        return close.start(), end + 1


def blocks(page: str | None) -> tuple[int, list[tuple[int, int, int, str]]]:
    """The page's story, and its lines in order: mark, form, slot and text."""
    out: list[tuple[int, int, int, str]] = []
    if not page:
        return 0, out
    stack: list[tuple[str, bool, bool, int]] = []
    # Where in the stack each name, and what is no inline element or ends the search for open paragraphs, stands.
    depths: dict[str, list[int]] = {}
    outer: list[int] = []
    scopes: list[int] = []
    text: list[str] = []
    drop = main = links = linked = 0
    title = heading = ""

    def place() -> tuple[str, int]:
        """The innermost block and its slot."""
        return (stack[outer[-1]][0], stack[outer[-1]][3]) if outer else ("", 0)

    def flush():
        nonlocal linked, heading
        if text:
            raw = "".join(text)
            line = " ".join(html_lib.unescape(raw).split())
            text.clear()
            if line:
                name, slot = place()
                form = LINKS if 2 * linked > len(raw) else PROSE if name in PROSE_BLOCKS else BARE
                mark = FURNITURE if drop else MAIN if main else OPEN
                out.append((mark, form, slot, line))
                if not heading and name == "h1":
                    heading = line
        linked = 0

    def write(piece: str):
        nonlocal linked
        text.append(piece)
        if links:
            linked += len(piece)

    def leave(depth: int):
        nonlocal drop, main, links
        while len(stack) > depth:
            name, d, m, _ = stack.pop()
            for held in (depths[name], outer, scopes):
                if held and held[-1] == len(stack):
                    held.pop()
            drop -= d
            main -= m
            links -= name == "a"

    scanner, at, end = Scanner(page), 0, len(page)
    tokens = scanner.tokens()
    for start, behind, closing, name, raw in tokens:
        if start > at:
            write(page[at:start])
        at = behind
        if not name:
            if raw is not None:
                write(html_lib.escape(raw))
            continue
        if name not in INLINE:
            flush()
        if closing:
            held = depths.get(name)
            if held and (name not in INLINE or not outer or held[-1] > outer[-1]):
                if stack[held[-1]][1] or stack[held[-1]][2]:
                    flush()
                leave(held[-1])
            continue
        if name in RAW:
            close = scanner.behind(name, at)
            if raw.endswith("/") and name == "svg" and close is None:
                continue
            if name == "title" and not title:
                title = page[at : close[0] if close else end]
            at = close[1] if close else end
            tokens.send(at)
            continue
        if name in VOID or (raw.endswith("/") and name in INLINE):
            continue
        if name not in INLINE:  # an open paragraph or list item ends here
            limit, ended = scopes[-1] if scopes else -1, ("p", *PAIRED.get(name, ()))
            while (depth := max((depths[x][-1] for x in ended if depths.get(x)), default=-1)) > limit:
                other = stack[depth][0]
                leave(depth)
                if other != "p":
                    break
        d, m = _decide(name, raw, main > 0)
        if (d or m) and name in INLINE:
            flush()
        slot = 0 if name in INLINE else _slot(place()[1], name, raw)
        depths.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            outer.append(len(stack))
        if name in SCOPES:
            scopes.append(len(stack))
        stack.append((name, d, m, slot))
        drop += d
        main += m
        links += name == "a"
    if at < end:
        write(page[at:])
    flush()
    named = " ".join(title.split()) + "\n" + heading
    return _hash(named if named != "\n" else "\n".join(line for _, _, _, line in out)), out


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Equal ends are cut off.  A column of the table is held as one bit for each
    line of ``a`` (a zero where the length grows); only every ``KEPT_ROWS``-th is
    kept, and those between are made again on the way back.
    """
    start, ends = 0, (len(a), len(b))
    while start < min(ends) and a[start] == b[start]:
        start += 1
    i, j = ends
    while i > start and j > start and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    found = {*range(start), *range(i, len(a))}
    n, other = i - start, b[start:j]
    where: dict[int, int] = {}
    for x in range(n):
        where[a[start + x]] = where.get(a[start + x], 0) | 1 << x
    other = [line for line in other if line in where]
    if not other:
        return found
    full = (1 << n) - 1

    def columns(v: int, lines: list[int]) -> list[int]:
        out = [v]
        for line in lines:
            u = v & where[line]
            v = ((v + u) | (v - u)) & full
            out.append(v)
        return out

    kept, v = [], full
    for at in range(0, len(other), KEPT_ROWS):
        kept.append(v)
        v = columns(v, other[at : at + KEPT_ROWS])[-1]
    x = n - 1
    for at in reversed(range(0, len(other), KEPT_ROWS)):
        block = columns(kept[at // KEPT_ROWS], other[at : at + KEPT_ROWS])
        for y in range(len(block) - 1, 0, -1):
            # The highest line up to x where the length grows ends the subsequence; the
            # line of b took part if the length did not grow there one column before.
            grown = ~block[y] & ((1 << (x + 1)) - 1)
            if not grown:
                return found
            x = grown.bit_length() - 1
            if block[y - 1] >> x & 1:
                found.add(start + x)
                x -= 1
    return found


class Page:
    """What a comparison needs of a page."""

    def __init__(self, host: str, path: str, story: int, marks: list[int], forms: list[int], slots: list[int], hashes: list[int]):
        self.host, self.path, self.story, self.marks, self.forms, self.slots, self.hashes = host, path, story, marks, forms, slots, hashes
        self._runs = None

    @property
    def keys(self) -> list[int]:
        return [h ^ (s * 0x9E3779B1) for h, s in zip(self.hashes, self.slots, strict=True)]

    @property
    def runs(self) -> tuple[list[int], list[range], dict[int, int]]:
        """Slots of neighbouring lines once, the lines of each, and how often a slot occurs."""
        if self._runs is None:
            slots, lines, at, often = [], [], 0, {}
            for slot, group in groupby(self.slots):
                n = sum(1 for _ in group)
                slots.append(slot)
                lines.append(range(at, at + n))
                often[slot] = often.get(slot, 0) + n
                at += n
            self._runs = slots, lines, often
        return self._runs


def partners(page: Page, neighbours: list[Page]) -> list[Page]:
    """The neighbours whose path shares the most leading segments."""
    near = [_common(page.path, other.path) for other in neighbours]
    return [other for other, n in zip(neighbours, near, strict=True) if n == max(near)]


def furniture(page: Page, neighbours: list[Page]) -> set[int]:
    """The lines that the alignments with the neighbours show to be furniture."""
    if not neighbours or not page.slots:
        return set()
    keys, (slots, lines, often) = page.keys, page.runs
    shared = [shared_lines(keys, other.keys) for other in partners(page, neighbours)]
    gone = {i for i in range(len(keys)) if 2 * sum(i in s for s in shared) >= len(shared)}
    aligned = set(range(len(slots)))
    for other in neighbours:
        aligned &= shared_lines(slots, other.runs[0])
    single = {s for s in slots if often[s] == 1 and all(other.runs[2].get(s) == 1 for other in neighbours)}
    for r in aligned:
        gone |= {i for i in lines[r] if page.forms[i] == LINKS or (page.forms[i] == BARE and slots[r] in single)}
    return {i for i in gone if page.marks[i] != MAIN}


def main_text(marks: list[int], lines: list[str], gone: set[int]) -> str:
    return " ".join(line for i, line in enumerate(lines) if marks[i] == MAIN or (marks[i] == OPEN and i not in gone))


def nearest_stories(pages: list[Page], i: int, step: int, wanted: int = SIDE) -> list[Page]:
    """The nearest pages of other stories on one side of a page's host."""
    seen, out, j = {pages[i].story}, [], i + step
    while 0 <= j < len(pages) and pages[j].host == pages[i].host and len(out) < wanted:
        if pages[j].story not in seen:
            seen.add(pages[j].story)
            out.append(pages[j])
        j += step
    return out


def _id_key(v):
    return (v is not None, 0 if v is None else v)


def _common(a: str, b: str) -> int:
    """Leading path segments that two paths share."""
    pairs = zip(a.split("/"), b.split("/"), strict=False)
    return sum(1 for _ in takewhile(lambda p: p[0] == p[1], pairs))


_FIELDS = ("host", "path", "story", "marks", "forms", "slots", "hashes")
_PAGE = "host string, path string, story long, marks array<tinyint>, forms array<tinyint>, slots array<int>, hashes array<long>"
_EDGE = "array<struct<" + _PAGE.replace("string", ": string").replace("long,", ": long,").replace("array", ": array") + ">>"


def _ordered(table: pa.Table) -> tuple[list[int], list[Page]]:
    """Row numbers in order of host, path, id and story, and the pages in that order."""
    c = {name: table.column(name).to_pylist() for name in ("page_id", *_FIELDS)}
    order = sorted(range(table.num_rows), key=lambda i: (c["host"][i], c["path"][i], _id_key(c["page_id"][i]), c["story"][i]))
    return order, [Page(*(c[name][i] for name in _FIELDS)) for i in order]


def _edge(pages: list[Page], step: int) -> list[dict]:
    """The outermost stories of the host at one end, nearest to the end first."""
    at = len(pages) - 1 if step < 0 else 0
    out = [pages[at], *nearest_stories(pages, at, step)]
    return [{name: getattr(p, name) for name in _FIELDS} for p in out]


def _needs(ends: dict[int, tuple]) -> list[tuple[int, int, int]]:
    """``part, source, step``: whose edges each range needs, up to enough stories or the host's end.

    ``ends`` has, for each range, the host and the stories at its first and at its last page.
    """
    out, known = [], sorted(ends)
    place = {part: i for i, part in enumerate(known)}
    for part in known:
        for step in (-1, 1):
            host = ends[part][0 if step < 0 else 2]
            i, seen = place[part] + step, set()
            while 0 <= i < len(known) and len(seen) <= SIDE:
                first_host, first, last_host, last = ends[known[i]]
                if host != (last_host if step < 0 else first_host):
                    break
                out.append((part, known[i], step))
                seen |= set(last if step < 0 else first)
                if first_host != last_host:  # the host ends inside this range
                    break
                i += step
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bucket: int = BUCKET, decided: bool = False) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page.

    ``decided`` adds how lines were told: ``n_lines, n_differenced`` (deleted by an
    alignment), ``n_marked`` (deleted by marks alone) and ``n_vetoed`` (shared with
    a partner, kept as article text).
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"), path.alias("path"))
    id_type = rows.schema["page_id"].dataType.simpleString()

    n = rows.count()
    parts = max(1, min(RANGES, -(-n // bucket)), min(2 * shuffle_width(spark), n // min(LEAST, bucket)))
    keys = rows.select("host", "path", "page_id")
    if parts > 1 and n > SAMPLE * parts * 2:
        keys = keys.sample(SAMPLE * parts / n, seed=1)
    ranked = sorted((r["host"], r["path"], _id_key(r["page_id"])) for r in keys.collect()) if parts > 1 else []
    bounds = [ranked[len(ranked) * k // parts] for k in range(1, parts)] if ranked else []

    def cut(with_lines):
        def run(batches):
            turn = count()
            for batch in batches:
                c = {name: batch.column(name).to_pylist() for name in ("page_id", "html", "host", "path")}
                out = {name: [] for name in ("part", "story", "marks", "forms", "slots", "hashes", "lines")}
                for i in range(batch.num_rows):
                    key = (c["host"][i], c["path"][i], _id_key(c["page_id"][i]))
                    low, high = bisect_left(bounds, key), bisect_right(bounds, key)
                    out["part"].append(low + next(turn) % (high - low + 1) if high > low else low)  # equal keys may fill several ranges
                    story, found = blocks(c["html"][i])
                    out["story"].append(story)
                    for name, values in zip(("marks", "forms", "slots", "lines"), zip(*found, strict=True) if found else ([],) * 4, strict=True):
                        out[name].append(list(values))
                    out["hashes"].append([_hash(x) for x in out["lines"][-1]])
                kinds = {"marks": pa.int8(), "forms": pa.int8(), "slots": pa.int32(), "hashes": pa.int64()}
                columns = {"part": pa.array(out["part"], pa.int32()), **{name: batch.column(name) for name in ("page_id", "host", "path")}, "story": pa.array(out["story"], pa.int64())}
                columns |= {name: pa.array(out[name], pa.list_(kind)) for name, kind in kinds.items()}
                if with_lines:
                    columns |= {"url": batch.column("url"), "lines": pa.array(out["lines"], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return run

    light = f"part int, page_id {id_type}, {_PAGE}"

    def edges(table: pa.Table) -> pa.Table:
        _, found = _ordered(table)
        kind = pa.struct([("host", pa.string()), ("path", pa.string()), ("story", pa.int64()), ("marks", pa.list_(pa.int8())), ("forms", pa.list_(pa.int8())), ("slots", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])
        ends = [pa.array([_edge(found, step)], pa.list_(kind)) for step in (1, -1)]
        return pa.table([table.column("part").slice(0, 1), *ends], names=["part", "first", "last"])

    carried = spark.createDataFrame([], f"part int, source int, step int, edge {_EDGE}")
    if bounds:
        held = materialise(rows.mapInArrow(cut(False), light).groupBy("part").applyInArrow(edges, f"part int, first {_EDGE}, last {_EDGE}"), "edges")
        # Of each range only host names and story numbers come here.
        told = held.select("part", F.col("first")[0]["host"].alias("fh"), F.col("first.story").alias("fs"), F.col("last")[0]["host"].alias("lh"), F.col("last.story").alias("ls"))
        needs = _needs({r["part"]: (r["fh"], r["fs"], r["lh"], r["ls"]) for r in told.collect()})
        if needs:
            asked = spark.createDataFrame(needs, "part int, source int, step int")
            edge = F.when(F.col("step") < 0, F.col("last")).otherwise(F.col("first"))
            carried = asked.join(held.withColumnRenamed("part", "source"), "source").select("part", "source", "step", edge.alias("edge"))

    def difference(table: pa.Table, beside: pa.Table) -> pa.Table:
        order, inside = _ordered(table)
        sides: dict[int, list[Page]] = {-1: [], 1: []}
        for r in sorted(beside.to_pylist(), key=lambda r: r["step"] * r["source"]):  # nearest first on both sides
            sides[r["step"]] += [Page(*(p[name] for name in _FIELDS)) for p in r["edge"]]
        around = [*reversed(sides[-1]), *inside, *sides[1]]
        lines, ids, urls = table.column("lines"), table.column("page_id"), table.column("url")
        texts, numbers = [], []
        for i, row in enumerate(order, len(sides[-1])):
            page, own = around[i], lines[row].as_py()
            neighbours = nearest_stories(around, i, -1) + nearest_stories(around, i, 1)
            gone = furniture(page, neighbours)
            texts.append(main_text(page.marks, own, gone))
            if decided:
                keys = page.keys
                vetoed = {k for p in partners(page, neighbours) for k in shared_lines(keys, p.keys) if page.marks[k] == MAIN}
                numbers.append((len(own), len(gone), sum(m == FURNITURE and k not in gone for k, m in enumerate(page.marks)), len(vetoed)))
        take = pa.array(order, pa.int64())
        columns = [ids.take(take), urls.take(take), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        columns += [pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)]
        return pa.table(columns, names=names)

    names = ["page_id", "url", "text", "n_chars"] + (["n_lines", "n_differenced", "n_marked", "n_vetoed"] if decided else [])
    schema = f"page_id {id_type}, url string, text string, n_chars long" + "".join(f", {name} long" for name in names[4:])

    def worked(table: pa.Table, beside: pa.Table) -> pa.Table:
        if not table.num_rows:  # edges for a range without pages: none is asked for
            kinds = [table.schema.field("page_id").type, pa.string(), pa.string()] + [pa.int64()] * (len(names) - 3)
            return pa.table([pa.array([], k) for k in kinds], names=names)
        return difference(table, beside)

    parsed = rows.mapInArrow(cut(True), f"{light}, url string, lines array<string>")
    return parsed.groupBy("part").cogroup(carried.groupBy("part")).applyInArrow(worked, schema)
