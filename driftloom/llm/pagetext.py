"""The main text of web pages.

A page is read into lines: what stands in a block, references decoded, white
space folded.  Elements and names that stand for menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments take their
lines away; where an ``article`` (or else ``main``) says what the text is, its
lines are.  On pages that don't say so, every other line is open, and open
lines are told by differencing: pages are put in order of host and path, each
is paired with its nearest neighbour of another path, lines are aligned by a
longest common subsequence, and those that both have are deleted.

Differencing alone would be wrong where markup speaks: an advert differs from
page to page, and a sentence that two articles share belongs to both.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_apart, cut

#: Elements that are never part of a text, whose content is no markup, and that have none.
ASIDE = frozenset("nav header footer aside form dialog menu button select fieldset noscript template svg math object applet audio video canvas head datalist".split())
RAW = frozenset("script style textarea title iframe noframes noembed xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An element that a new one of the key ends, unless one of the others stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of a class or id, and roles, that name what is no text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright discussion disqus"
    " footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification notifications pager pagination popup promo promos promotion recommended"
    " related replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription teaser toolbar widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OPEN, TEXT, NAMED = range(3)
#: Lines times lines that an alignment keeps at once; larger ones are halved.
CELLS = 1 << 26

_TAG = re.compile(r"<!--(?:-?>|.*?--!?>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
_NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I | re.S)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def _is_named(attributes: str) -> bool:
    """Whether class, id, role or style tell that an element is no text."""
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for part in value.split():
                # with-sidebar, has-ads and the like tell of a page's other parts
                if not re.match(r"(?:has|with|no|is|not)[-_]", part) and any(w.lower() in NAMES for w in _WORDS.findall(part)):
                    return True
        elif name == "role":
            if value.lower() in ROLES:
                return True
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def _main_role(attributes: str) -> str | None:
    role = next((v.strip("\"'").lower() for n, v in _NAMED.findall(attributes) if n.lower() == "role"), None)
    return role if role in ("main", "article") else None


def lines_of(page: str | None, names: bool = True) -> list[tuple[int, str]]:
    """(OPEN, TEXT or NAMED, text) of each line; TEXT is what stands in an article, or in main where there is none.

    Unless ``names``, only elements tell what is no text.
    """
    page = page or ""
    stack: list[tuple[str, bool, str]] = []  # element, whether it is no text, innermost article or main around
    found: list[tuple[bool, str, str]] = []
    held: list[tuple[bool, str]] = []
    gone, within = False, ""

    def end_line() -> None:
        for apart in (False, True) if held else ():  # an inline element may be no text amid a line that is
            text = " ".join(_html.unescape("".join(x for g, x in held if g == apart)).split())
            if text:
                found.append((apart, within, text))
        held.clear()

    def close(to: int) -> None:
        nonlocal gone, within
        if any(name in BLOCKS for name, _, _ in stack[to:]):
            end_line()
        del stack[to:]
        gone, within = stack[-1][1:] if stack else (False, "")

    at = 0
    while at < len(page):
        tag = _TAG.search(page, at)
        if tag is None:
            held.append((gone, page[at:]))
            break
        if tag.start() > at:
            held.append((gone, page[at : tag.start()]))
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name == "br":
            held.append((gone, " "))
        elif tag[1]:
            to = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if to is not None:
                close(to)
            elif name in BLOCKS:
                end_line()
        elif name in RAW:
            if name not in ("script", "style"):
                held.append((gone, " "))
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            if name in BLOCKS:
                end_line()
                ended, until = ENDS.get(name, (frozenset(), frozenset()))
                for i in range(len(stack) - 1, -1, -1):
                    one = stack[i][0]
                    if one in ended or one == "p":
                        close(i)
                        if one != "p":
                            break
                    elif one in until or one in BLOCKS and not ended:
                        break
            if name in VOID or tag[3].endswith("/") and name in ("svg", "math"):
                continue
            kind = name if name in ("article", "main") else _main_role(tag[3]) if "role" in tag[3].lower() else None
            told = names and kind != "main" and name not in ("html", "body") and _is_named(tag[3])
            aside = name in ASIDE and not (name == "header" and within)
            # an article in an article is a comment on it
            own = gone or told or aside or kind == "article" and within == "article"
            if kind == "main":
                own = any(n in ASIDE for n, _, _ in stack)  # a named element around it is a layout
            stack.append((name, own, "article" if kind == "article" or within == "article" else kind or within))
            gone, within = own, stack[-1][2]
    end_line()
    marked = "article" if any(w == "article" and not g for g, w, _ in found) else "main"
    return [(NAMED if g else TEXT if w == marked else OPEN, t) for g, w, t in found]


def read_page(page: str | None, markup: bool = True) -> tuple[bool, list[tuple[int, str]]]:
    """Whether markup says what the text is, and the lines."""
    if not markup:
        return False, [(OPEN, t) for _, t in lines_of(page)]
    lines = lines_of(page)
    if all(kind != TEXT for kind, _ in lines) and re.search("<(?:article|main)", page or "", re.I):
        again = lines_of(page, names=False)  # a name around the article misled
        lines = again if any(kind == TEXT for kind, _ in again) else lines
    return any(kind == TEXT for kind, _ in lines), lines


def place_of(url: str | None) -> tuple[str, str]:
    """Host and path of a url; both empty of none."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", (url or "").strip()).removeprefix("//")
    host, _, path = re.split(r"[?#]", rest, maxsplit=1)[0].partition("/")
    return host.rpartition("@")[2].lower(), path


def common_lines(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, by bit vectors; large ones are halved to bound what is held."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < min(len(a), len(b)) - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [*range(low)], [*range(len(a) - tail, len(a))]
    a, b = a[low : len(a) - tail], b[low : len(b) - tail]
    if not a or not b:
        return ends[0] + ends[1]
    if len(a) * len(b) > CELLS and len(a) > 1:
        half = len(a) // 2
        ahead, back = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        cut_at = max(range(len(b) + 1), key=lambda j: ahead[j] + back[len(b) - j])
        found = common_lines(a[:half], b[:cut_at]) + [half + i for i in common_lines(a[half:], b[cut_at:])]
    else:
        rows, (i, j), found = _rows(a, b), (len(a), len(b)), []
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if rows[i] >> (j - 1) & 1:
                found.append(i)
                j -= 1
        found.reverse()
    return ends[0] + [low + i for i in found] + ends[1]


def _rows(a: list, b: list) -> list[int]:
    """For each prefix of ``a`` a number whose bit j is 0 where one more of ``b`` makes the common subsequence longer."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    all_bits = (1 << len(b)) - 1
    rows = [all_bits]
    for x in a:
        both = rows[-1] & at.get(x, 0)
        rows.append(((rows[-1] + both) | (rows[-1] - both)) & all_bits)
    return rows


def _lengths(a: list, b: list) -> list[int]:
    """Lengths of the longest common subsequence of ``a`` with each prefix of ``b``."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    all_bits = row = (1 << len(b)) - 1
    for x in a:
        both = row & at.get(x, 0)
        row = ((row + both) | (row - both)) & all_bits
    found = [0]
    for bit in reversed(bin(row)[2:].zfill(len(b))):
        found.append(found[-1] + (bit == "0"))
    return found


def _hashes(lines: list[tuple[int, str]]) -> list[int]:
    import xxhash

    return [(h := xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))) - ((h >> 63) << 64) for _, t in lines]


def _outlines(pages: DataFrame, markup: bool) -> DataFrame:
    """site, path, page_id, lines: the hashed lines of every page that no article has."""

    def work(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, len(batch), 200)):
                places = [place_of(u) for u in part.column(1).to_pylist()]
                lines = [_hashes([x for x in read_page(p, markup)[1] if x[0] != TEXT]) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in places], pa.string()), pa.array([p for _, p in places], pa.string()), part.column(0), pa.array(lines, pa.list_(pa.int64()))], ["site", "path", "page_id", "lines"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(work, f"site string, path string, page_id {kind}, lines array<long>")


def nearest(path: str, before: str | None, after: str | None) -> int | None:
    """0 or 1: which of two paths has more leading segments in common, then more letters, then comes first; None if there is none."""
    best = None
    for i, other in enumerate((before, after)):
        if other is not None:
            segments = letters = 0
            for x, y in zip(path.split("/"), other.split("/")):
                if x != y:
                    break
                segments += 1
            for x, y in zip(path, other):
                if x != y:
                    break
                letters += 1
            if best is None or (segments, letters) > best[0]:
                best = (segments, letters), i
    return None if best is None else best[1]


def partners(pages: DataFrame, markup: bool = True) -> DataFrame:
    """site, path, other: for each path of each host the hashed lines of the nearest page of another path.

    Pages of one path are one page, that of the smallest page_id.  Paths are
    dealt to tasks in their order, hosts of any size over many; the ends of the
    tasks' stretches, two a task, are held against each other apart.  A page
    whose lines are all those of a neighbour is no partner of it.
    """
    outlines = _outlines(columns_apart(pages, "page_id", "url", "html"), markup)
    entries = outlines.groupBy("site", "path").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "lines"))["lines"].alias("lines"))
    ordered = entries.repartitionByRange("site", "path").withColumn("part", F.spark_partition_id())
    ordered = cut(ordered, "ordered")
    own = F.struct("site", "path", "lines")
    by = Window.partitionBy("part").orderBy("site", "path")
    near = ordered.select("*", F.lag(own).over(by).alias("before"), F.lead(own).over(by).alias("after"))
    ends = ordered.groupBy("part").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    across = Window.orderBy("part")
    ends = cut(ends.select("part", F.lag("last").over(across).alias("_before"), F.lead("first").over(across).alias("_after")), "ends")
    near = near.join(F.broadcast(ends), "part").select("site", "path", "lines", F.coalesce("before", "_before").alias("before"), F.coalesce("after", "_after").alias("after"))
    same = lambda c: F.when((F.col(f"{c}.site") == F.col("site")) & (F.col(f"{c}.lines") != F.col("lines")), F.col(c))
    near = near.select("site", "path", same("before").alias("before"), same("after").alias("after")).where("before is not null or after is not null")

    def work(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            before, after = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            chosen = [(x, y)[nearest(p, x and x["path"], y and y["path"])]["lines"] for p, x, y in zip(batch.column(1).to_pylist(), before, after)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chosen, pa.list_(pa.int64()))], ["site", "path", "other"])

    return near.mapInArrow(work, "site string, path string, other array<long>")


def main_texts(pages: DataFrame, markup: bool = True) -> DataFrame:
    """page_id, url, text of every row of (page_id, url, html).

    Lines are joined by one space, in page order.  A null html has an empty
    text; a page without a url, or alone on its host, has no partner and keeps
    its open lines.  Repeated rows are pages of their own, very long pages are
    read whole, no rows give none.  Other columns are ignored, whatever their
    names.  Unless ``markup``, only differencing tells what the text is.
    """
    own = columns_apart(pages, "page_id", "url", "html")
    kinds = [own.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def sort_out(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, len(batch), 200)):
                texts, rest, sites, paths = [], [], [], []
                for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    said, lines = read_page(page, markup)
                    open_ = not said and any(kind == OPEN for kind, _ in lines)
                    texts.append(None if open_ else " ".join(t for kind, t in lines if kind == TEXT))
                    rest.append([t for kind, t in lines if kind == OPEN] if open_ else None)
                    site, path = place_of(url) if open_ else (None, None)
                    sites.append(site)
                    paths.append(path)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(rest, pa.list_(pa.string())), pa.array(sites, pa.string()), pa.array(paths, pa.string())], ["page_id", "url", "text", "open", "site", "path"])

    def difference(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for lines, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                shared = set(common_lines(_hashes([(OPEN, t) for t in lines]), other)) if other else ()
                texts.append(" ".join(t for i, t in enumerate(lines) if i not in shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    told = own.mapInArrow(sort_out, f"page_id {kinds[0]}, url {kinds[1]}, text string, open array<string>, site string, path string")
    done = told.where("open is null").select("page_id", "url", "text")
    rest = told.where("open is not null").join(partners(own, markup), ["site", "path"], "left").select("page_id", "url", "open", "other")
    return done.unionByName(rest.mapInArrow(difference, f"page_id {kinds[0]}, url {kinds[1]}, text string"))
