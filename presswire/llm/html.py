"""Main text of web pages: site templates found as subtrees that recur on a host."""

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written

# The language of pages
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select button".split())
BLOCKS = frozenset(("html head body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form "
                    "h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption").split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TEXTUAL = frozenset("html body main p h1 h2 h3 h4 h5 h6 li dt dd td th caption pre blockquote address summary figcaption option".split())
KEEPERS = frozenset("ul ol menu dl table tr article section div main aside nav header footer form body blockquote".split())
# Names of what is not the article
AROUND = frozenset("nav footer aside form dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset(("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb "
                   "breadcrumbs sidebar sidebars footer masthead notice notices cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login "
                   "share sharing social related recommended recommendations comment comments disqus replies respond widget widgets toolbar pagination pager "
                   "skip disclaimer alert").split())
DENIED = frozenset("no not non has have with without hide hidden".split())  # a class that begins so tells of the page, not of the element

# Names of boxes whose texts differ from page to page, and of what readers write
SIDE = frozenset(("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion breadcrumb breadcrumbs sidebar sidebars cookie cookies consent gdpr popup modal "
                  "newsletter subscribe subscription signup share sharing related recommended recommendations comment comments disqus replies respond widget widgets pagination pager").split())
READERS = frozenset("comment comments disqus replies respond".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+")

PAGE_SHARE, PAGE_LEAST = 0.3, 3    # of a host's pages that a subtree of a template is on
INSIDE_SHARE, INSIDE_LEAST = 0.8, 10  # of a host's pages with such a place that a subtree inside the article is on
SHAPE_LEAST = 2                    # pages that a side element of such a place and name is on
HOST_SHARE = 0.001  # of a host's pages that any template is on, which bounds a host's list of them
KEY, MENU, NAME, NAMED = range(4)  # what a mark on a run of blocks is the hash of


class _Element:
    __slots__ = ("tag", "around", "root", "named", "side", "kinds", "listed", "slot", "menu", "parts", "links", "size", "start", "direct")

    def __init__(self, tag, names, around, root, slot, start):
        self.tag, self.around, self.root = tag, around, root
        self.named = _named(tag, names)
        self.side = _side(tag, names, SIDE) if self.named else False
        self.kinds, self.listed = [], False  # tags and names of its parts; whether like-shaped ones are somewhere inside
        self.slot = _hash(f"{slot}\x00{tag}\x00{names}")  # its place: tags and names from the top down
        self.parts = [tag, names]      # what the subtree's hash is made of
        self.menu = [tag, names]       # the same without texts
        self.links, self.size = 0, 0   # letters inside links, letters
        self.start = start             # its first block
        self.direct = []               # its blocks that have no hash yet of an element around them


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _around(tag: str, roles: str, inside_root: bool) -> bool:
    return tag in AROUND or roles in ROLES or tag == "header" and not inside_root


def _named(tag: str, names: str) -> int:
    """What class and id tell: 3 if one of them is a name of what is not the article and
    the element is no text itself, 2 if one ends in such a name, 1 if a name occurs, else 0."""
    if NAMES.isdisjoint(PART.findall(names)):
        return 0
    if tag in TEXTUAL or tag not in BLOCKS:
        return 1
    words = names.split()
    if any(w in NAMES for w in words):
        return 3
    parts = [PART.findall(w) for w in words]
    return 2 if any(p and p[-1] in NAMES and p[0] not in DENIED for p in parts) else 1


def _side(tag: str, names: str, words: frozenset) -> bool:
    """Whether an element that is no text itself has a class that begins or ends in one of the words."""
    if tag in TEXTUAL - {"li"} or tag not in BLOCKS:
        return False
    parts = [PART.findall(w) for w in names.split()]
    return any(p and p[0] not in DENIED and (p[0] in words or p[-1] in words) for p in parts)


def parse(page: str) -> tuple[list[tuple[str, bool, int | None]], list[tuple[int, int, int, int]], bool, dict[int, tuple[int, bool, bool]]]:
    """The blocks of text of a page, marks on them, whether the page marks its article, and its subtrees.

    A block is (text, inside the article, hash of the subtree right around it). A
    mark is (kind, hash, first block, end): an element around a run of blocks, by the hash of its
    subtree, its menu, its name, or as a named subtree, where it holds nothing of an
    article. Each element has its marks once, however deep it is. Text inside elements whose tag or
    role is not part of the article, and inside scripts, styles and the like, is
    left out, and so is that of side elements with such a name as a class or
    id. Names do not count for elements that hold half of the article's text or
    more; where none is marked, half of the page's, unless the host has the name on
    small ones. A list of like-shaped parts in an element named after comments is left out as well. Each subtree hash
    comes with its place, that of a name being all elements of the name, 0 for menus, and
    with whether it is a named subtree's, and whether that of the shape of a side element, its
    place without its texts.
    """
    blocks, stack, buffer, marks = [], [], [], []
    seen_root, named, subtrees = False, [], {}
    tags, arounds, rooted = Counter(), 0, 0  # of the open elements

    def flush():
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text and not arounds:
            if stack:
                stack[-1].direct.append(len(blocks))
            blocks.append([text, rooted > 0, None])
        if text and stack:
            stack[-1].parts.append(text)
            stack[-1].size += len(text)

    def close():
        nonlocal arounds, rooted
        flush()
        e = stack.pop()
        tags[e.tag] -= 1
        arounds -= e.around
        rooted -= e.root
        start, end = e.start, len(blocks)
        key, menu = _hash("\x00".join(e.parts)), _hash("\x00".join(dict.fromkeys(e.menu)))
        plain = e.tag not in ("html", "body") and not e.root  # others are never a template
        links = bool(e.size) and e.links >= 0.8 * e.size
        e.listed |= len(set(e.kinds)) < len(e.kinds)
        if end > start and plain:
            for i in e.direct:
                blocks[i][2] = key
            marks.append((KEY, key, start, end))
            subtrees.setdefault(key, (e.slot, False, False))
        if end > start and links:
            marks.append((MENU, menu, start, end))
            subtrees.setdefault(menu, (0, False, False))
        if end > start and e.named:
            named.append((e, key, end))
        if stack:
            up = stack[-1]
            up.parts.append(str(key))
            up.menu.append(str(menu))
            if end > start and (e.tag not in TEXTUAL or e.tag in ("li", "dd")):
                up.kinds.append(f"{e.tag} {e.menu[1]}")
            up.listed |= e.listed
            up.links += e.links
            up.size += e.size
            if not plain:
                up.direct += e.direct

    def judge():
        """Use the names, now that it is known how much each element holds."""
        weight = [0, *accumulate(len(b[0]) if b[1] or not seen_root else 0 for b in blocks)]
        gone = [0] * (len(blocks) + 1)
        for e, key, end in named:
            large = 2 * (weight[end] - weight[e.start]) >= weight[-1]
            name, place = _hash("\x00".join(["name", *e.menu[:2]])), _hash("\x00".join(["place", *e.menu[:2]]))
            if e.named >= 2:
                subtrees.setdefault(place if large else name, (place, False, False))
            if e.side and not large and not e.root:
                shape = _hash(f"shape\x00{e.slot}")
                marks.append((NAMED, shape, e.start, end))
                subtrees[shape] = (0, False, True)
            if large and (e.named < 3 or seen_root):
                continue
            readers = e.listed and not e.root and _side(e.tag, e.menu[1], READERS)
            if (e.named == 3 or readers) and not large:
                gone[e.start] += 1
                gone[end] -= 1
            if e.named >= 2:
                marks.append((NAME, name, e.start, end))
            if not large:
                marks.append((NAMED, key, e.start, end))
                subtrees[key] = (subtrees.get(key, (e.slot, False, False))[0], True, False)
        stays = [depth == 0 for depth in accumulate(gone[:-1])]
        place = [0, *accumulate(map(int, stays))]
        runs = dict.fromkeys((kind, key, place[start], place[end]) for kind, key, start, end in marks)
        return [tuple(b) for b, kept in zip(blocks, stays) if kept], [m for m in runs if m[2] < m[3]]

    position, end, in_link = 0, len(page), 0
    while position < end:
        found = TOKEN.search(page, position)
        text = page[position:found.start() if found else end]
        if text:
            buffer.append(text)
            if in_link and stack:
                stack[-1].links += len(" ".join(text.split()))
        if not found:
            break
        position = found.end()
        if found[2] is None:
            continue
        closing, tag = found[1], found[2].lower()
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in RAW:
            if not closing and not (tag in ("svg", "math") and found[3].endswith("/")):
                finish = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, position)
                position = finish.end() if finish else end
            buffer.append(" ")
        elif tag == "br" or tag == "hr":
            buffer.append(" ")
        elif closing:
            if tags[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
        elif tag in BLOCKS or tag == "option" or _marked(found[3]):
            if tag in VOID:
                continue
            names, roles = _names(found[3])
            while tag in BLOCKS and tags["p"] and any(e.tag == "p" for e in stack[_keeper(stack):]):
                close()
            ends = CLOSES.get(tag, ())
            level = _open(stack, ends) if ends else None
            while level is not None and len(stack) > level:
                close()
            if tag in BLOCKS:
                flush()
            elif buffer:
                flush()
            around = _around(tag, roles, rooted > 0)
            root = not around and (tag in ("article", "main") or roles in ("main", "article"))
            seen_root = seen_root or root and not arounds
            stack.append(_Element(tag, names, around, root, stack[-1].slot if stack else 0, len(blocks)))
            tags[tag] += 1
            arounds += around
            rooted += root
    flush()
    while stack:
        close()
    kept, runs = judge()
    return kept, runs, seen_root, subtrees


def _open(stack, ends: tuple[str, ...]) -> int | None:
    """The place of the open element that a new one of its kind ends, if nothing between keeps it."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].tag in ends:
            return i
        if stack[i].tag in KEEPERS:
            return None
    return None


def _marked(attributes: str) -> bool:
    """Whether an inline element is named as something around the article."""
    if "=" not in attributes:
        return False
    names, roles = _names(attributes)
    return roles in ROLES or not NAMES.isdisjoint(PART.findall(names))


def _names(attributes: str) -> tuple[str, str]:
    if "=" not in attributes:
        return "", ""
    names, roles = [], ""
    for kind, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if kind.lower() == "role":
            roles = value.strip()
        else:
            names.append(value)
    return " ".join(names), roles


def _keeper(stack) -> int:
    """The place after the last element that a paragraph cannot outgrow."""
    return next((i + 1 for i in range(len(stack) - 1, -1, -1) if stack[i].tag in KEEPERS), 0)


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url).hostname or "") if isinstance(url, str) else ""
    except ValueError:
        return ""


def main_text(pages: DataFrame) -> DataFrame:
    """Extract the main text of pages (page_id, url, html).

    Element subtrees are hashed with all they hold, and lists of links also
    without their texts. Spark counts on how many pages of a host each hash
    occurs, pages of equal html once. On every page a subtree is deleted that is
    on ten pages, and on 80 % of the host's pages that have an element in such a
    place (tags, classes and ids from the top down): a box on some of a host's pages goes, a
    passage among the paragraphs which many articles share stays. Outside of
    articles what encloses the text also goes from three pages and 30 % of the
    host's. Names in classes and ids are evidence: a name alone, of a side
    element, suffices; a class that ends in one has to be on ten pages, and on
    a side element on 80 % of those that have it; any other needs a subtree that is
    on three pages. Menus, headers, footers, asides
    and forms by tag or role go on any page, and at last, where a page marks its
    article, what is outside of it. No template is on under 0.1 % of a host's pages.

    Returns (page_id, url, text, n_chars) per row of pages. A null or empty html
    gives an empty text. Pages without a host share no template. Rows that repeat
    and null ids are extracted like others; other columns are ignored.
    """
    shape = ("page_id long, url string, host string, page long, marked boolean, blocks array<struct<text: string, inside: boolean, own: bigint>>, "
             "marks array<struct<kind: int, key: bigint, start: int, end: int>>, subtrees array<struct<key: bigint, slot: bigint, named: boolean, shape: boolean>>")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start:start + 256]
                sources = [x if isinstance(x, str) else "" for x in part["html"]]
                found = [parse(x) for x in sources]
                yield pd.DataFrame({
                    "page_id": part["page_id"].astype("Int64"), "url": part["url"], "host": [_host(u) for u in part["url"]],
                    "page": [_hash(x) for x in sources], "marked": [m for _, _, m, _ in found],
                    "blocks": [[dict(zip(("text", "inside", "own"), b)) for b in blocks] for blocks, _, _, _ in found],
                    "marks": [[dict(zip(("kind", "key", "start", "end"), m)) for m in marks] for _, marks, _, _ in found],
                    "subtrees": [[{"key": k, "slot": slot, "named": named, "shape": shaped} for k, (slot, named, shaped) in subtrees.items()] for *_, subtrees in found]})

    rows = written(pages.select("page_id", "url", "html").mapInPandas(read, shape), "pages")
    # hashes alone are shuffled, never texts
    once = rows.where("host <> ''").select("host", "page", "subtrees").dropDuplicates(["host", "page"])
    sizes = once.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    places = once.select("host", F.explode(F.array_distinct("subtrees.slot")).alias("slot")).where("slot <> 0").groupBy("host", "slot").agg(F.count(F.lit(1)).alias("placed"))
    counts = once.select("host", F.inline("subtrees")).groupBy("host", "key", "slot").agg(F.count(F.lit(1)).alias("n"), F.max("named").alias("named"), F.max("shape").alias("shape"))
    whole = counts.groupBy("host", "key").agg(F.sum("n").alias("n"), F.max("named").alias("named"), F.max("shape").alias("shape"), F.max(F.struct("n", "slot")).alias("top"))
    common = whole.where((F.col("n") >= PAGE_LEAST) | F.col("shape") & (F.col("n") >= SHAPE_LEAST)).join(sizes, "host").where(F.col("n") >= HOST_SHARE * F.col("pages"))
    common = common.withColumn("slot", F.col("top.slot")).join(places, ["host", "slot"], "left")
    often = F.col("n") >= PAGE_SHARE * F.col("pages")
    everywhere = (F.col("top.n") >= INSIDE_LEAST) & (F.col("top.n") >= INSIDE_SHARE * F.coalesce("placed", "pages"))
    common = common.select("host", "key", (often & ~F.col("shape")).alias("often"), (everywhere & ~F.col("shape")).alias("everywhere"), (F.col("named") | F.col("shape")).alias("named")).where("often or everywhere or named")
    # at most a page's hashes / HOST_SHARE per host
    template = common.groupBy("host").agg(*[F.collect_list(F.when(F.col(x), F.col("key"))).alias(x) for x in ("often", "everywhere", "named")])
    copies = rows.groupBy("host").agg(F.count(F.lit(1)).alias("copies"))
    template = written(copies.join(template, "host"), "templates")
    total = rows.count()
    none = F.array().cast("array<bigint>")
    joined = join_counted(rows.drop("subtrees"), template, "host", "copies", total)
    # of a host's templates those on the page, then the runs of blocks that these cover
    on_page = F.array_distinct(F.transform("marks", lambda m: m["key"]))
    joined = joined.withColumns({x: F.coalesce(F.array_intersect(on_page, x), none) for x in ("often", "everywhere", "named")})

    def covered(templates: str, *kinds: int):
        return F.filter("marks", lambda m: m["kind"].isin(*kinds) & F.array_contains(templates, m["key"]))

    def around(runs: str, i):
        return F.exists(runs, lambda m: (m["start"] <= i) & (i < m["end"]))

    spans = F.array_distinct(F.transform(F.concat(covered("everywhere", KEY, MENU, NAME), covered("named", NAMED)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    joined = joined.withColumns({"gone": spans, "menus": F.when(F.col("marked"), F.array().cast("array<struct<kind: int, key: bigint, start: int, end: int>>")).otherwise(covered("often", MENU)),
                                 "boxes": F.when(F.col("marked"), F.array().cast("array<struct<kind: int, key: bigint, start: int, end: int>>")).otherwise(covered("often", KEY))})

    def stays(b, i):
        boxed = F.exists("boxes", lambda m: (m["start"] <= i) & (i < m["end"]) & ~m["key"].eqNullSafe(b["own"]))
        return (b["inside"] | ~F.col("marked")) & ~around("gone", i) & ~around("menus", i) & ~boxed

    text = F.array_join(F.transform(F.filter("blocks", stays), lambda b: b["text"]), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
