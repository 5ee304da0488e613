"""Main text of web pages by nearest-URL page differencing.

A page is cut into its text blocks (one line each). Within a host, pages are ordered by
URL path, and each one is compared with the neighbour whose path shares the longer
prefix. Neighbours in the order whose text is mostly the same (``COPY`` of the characters
of the longer one, in lines that aren't furniture) are copies of one article; a page is
compared with the nearest path before or after the whole row of copies it stands in. If
its host has no such path, it is compared with a neighbour that differs in more than a
few lines (``ONLY_COPY``), and else with none. Lines are aligned by longest common subsequence; what both pages hold in the
same order is the site's template, and shared lines are deleted.

A line of text is compared by its words. A line of a template slot is compared by its place, the path of
elements with their class, id and role (digits apart): menus, adverts or footers whose words differ from page to page are shared
too, and every line of a shared slot goes. Slots are: elements whose tag or name tells of page
furniture; on a page whose article (article, main) holds at least as much text as the plain lines around it, every named
element outside of the article, but for h1; inside an article, elements named by nothing but words of furniture
(``share-buttons``, not ``share-price``). Lines of the article itself are never deleted by their text: copies of an article
occur within one host, and differencing alone would empty them.

What no page shares is then decided by rules. Elements whose meaning is
clear (menus, footers, adverts, forms, comments ...) go; of a form that
holds an article, or most of the page, only the controls go. Class words decide nothing inside an article,
but for comments, adverts and, on a page that is compared with none, the slots above. An article's own class
words do not make it furniture, unless they name a comment or an advert.

Defined cases: a null html is empty and gives an empty text; a null url, or one without
a host, has no neighbour, and neither has the only path of a host; pages of one path
are compared with the neighbour of that path, never with each other; a page of just the
same lines says nothing and deletes nothing, and a host of copies alone keeps its texts. Repeated rows give a row each.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import with_next
from .ship import arrow_map
from .store import written

# Elements of HTML by their role.
RAW = "script|style|noscript|template|textarea|title|iframe|svg|object|select"
DROPPED = frozenset("nav footer aside button dialog head menu".split())
#: What a form asks, in a form that wraps the page.
CONTROLS = frozenset("label legend optgroup option datalist output".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDED = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "tr", "td", "th"),
         "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",)}
#: Words of class, id or role that name what isn't part of an article.
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split())
PAGE_HEADS = frozenset(("header", "banner", "masthead", "topbar"))
#: Words that go with them in a name and say nothing of their own.
STRUCTURE = frozenset(
    "area articles bar block body box button buttons container content form icons inner item items links list outer posts section "
    "signup stories thread top bottom unit wrap wrapper".split())
#: Of ``NAMES``, what goes inside an article too, shared or not; and the roles that a tag could tell as well.
NEVER = frozenset("ad ads advert advertisement adverts comment comments disqus".split())
ROLES = frozenset("navigation complementary search dialog menu menubar toolbar".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
DIGITS = re.compile("[0-9]+")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

#: Share of text from which neighbours are copies, and from which a copy isn't compared at all.
COPY, ONLY_COPY = 2 / 3, 0.9

#: Zones of a line; NAMED: in an article, below a name of furniture.
OUT, PLAIN, ARTICLE, NAMED = 0, 1, 2, 3


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(text)} if text else {}


def _zone(tag: str, named: dict[str, str], zone: int) -> int:
    """The zone inside an element with these attributes that opens within ``zone``."""
    if zone == NAMED:
        return OUT if tag in DROPPED else zone
    words = set(re.split(r"[^a-z]+", " ".join(v for k, v in named.items() if k != "itemprop")))
    if tag in ("article", "main") or named.get("role") == "main" or named.get("itemprop") == "articlebody":
        # a comment or an advert is an article too, but stays out; a wrapper's name doesn't reach into the page's article
        own = set(f"{named.get('class', '')} {named.get('id', '')}".split())
        return OUT if own & {"comment", "comments"} or own and own <= {"ad", "ads", "advert", "advertisement"} else ARTICLE
    if zone == ARTICLE:
        words.discard("")
        only = words & NAMES and words <= NAMES | STRUCTURE
        return OUT if tag in DROPPED or named.get("role") in ROLES or only and words & NEVER else NAMED if only else zone
    if tag in DROPPED or tag not in ("body", "html") and words & NAMES and not words & {"has", "with", "no"}:
        return OUT
    if zone == PLAIN and (tag == "header" or words & PAGE_HEADS):
        return OUT
    return zone


def _step(path: int, tag: str, named: dict[str, str]) -> int:
    name = ".".join(DIGITS.sub("#", named.get(k, "")) for k in ("class", "id", "role"))
    return xxhash.xxh3_64_intdigest(f"{path}/{tag}.{name}".encode())


def page_lines(text: str) -> tuple[list[str], list[int]]:
    """(text, zone) of each block of a page, in order; white space as one space."""
    return page_blocks(text)[:2]


def page_blocks(text: str) -> tuple[list[str], list[int], list[int]]:
    """``page_lines`` and the path of each line as a number, 0 where no element on it has a name."""
    # the last of an open element: the number of the form it stands in, or 0; its path; whether something on that is named
    lines, zones, forms, slots, stack, parts = [], [], [], [], [("", PLAIN, False, 0, 0, False)], []
    at, outside = 0, []  # the zone around each form

    def close():
        if parts:
            line = " ".join(entities.unescape("".join(parts)).split())
            if line:
                lines.append(line)
                zones.append(stack[-1][1])
                forms.append(stack[-1][3])
                slots.append(stack[-1][4] if stack[-1][5] else 0)
            parts.clear()

    for m in TOKEN.finditer(text):
        if m.start() > at:
            parts.append(text[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            close()
            if not m[2]:  # what a block's start tag ends without an end tag
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ENDED.get(tag, ("p",)):
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCKS:
                        break
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if stack[k][1] != stack[-1][1] or stack[k - 1][1] != stack[-1][1]:
                        close()
                    del stack[k:]
                    break
        elif tag not in VOID and not m[4].endswith("/"):
            _, outer, closed, form, path, marked = stack[-1]
            named = _attributes(m[4])
            zone = _zone(tag, named, outer)
            if form and (tag == "form" or tag in CONTROLS):
                zone = OUT
            # what reader comments hold stays out, whatever it is marked as
            shut = closed or zone == OUT and tag not in ("main", "article", "html", "body") and (
                tag not in ("div", "section", "span", "form") or "comment" in m[4].lower())
            zone = OUT if closed else zone
            if zone != outer:
                close()
            if tag == "form" and not form:
                outside.append(outer)
                form = len(outside)
            if zone in (ARTICLE, NAMED) and outer in (OUT, PLAIN):
                path, marked = 0, False  # an article is the same place wherever it stands
            elif tag not in ("body", "html"):
                if tag in BLOCKS or named:
                    path = _step(path, tag, named)
                marked = marked or zone in (OUT, NAMED) or zone == PLAIN and (tag in ("header", "form") or bool(named))
                if tag == "h1" and zone == PLAIN:
                    marked = False  # a headline above the article is compared by its words
            stack.append((tag, zone, shut, form, path, marked))
    if at < len(text):
        parts.append(text[at:])
    close()
    return lines, _without_forms(lines, zones, forms, outside) if outside else zones, slots


def _without_forms(lines: list[str], zones: list[int], forms: list[int], outside: list[int]) -> list[int]:
    """The zones with forms left out, but for a form that wraps the page: it holds an article, or
    most of the lines and of the text that aren't left out."""
    held, marked = [[0, 0] for _ in range(len(outside) + 1)], set()
    for line, zone, form in zip(lines, zones, forms):
        if zone != OUT:
            held[form][0] += 1
            held[form][1] += len(line)
            if form and zone == ARTICLE != outside[form - 1]:
                marked.add(form)
    total = [sum(h[c] for h in held) for c in (0, 1)]
    wraps = {f for f in range(1, len(held)) if f in marked or all(2 * held[f][c] > total[c] for c in (0, 1))} | {0}
    return [z if f in wraps else OUT for z, f in zip(zones, forms)]


def common(a: list, b: list) -> np.ndarray:
    """Which items of ``a`` a longest common subsequence with ``b`` aligns. Bit-parallel: one
    row of bits per item of ``a``; a zero bit is a place of ``b`` where the length grows."""
    out = np.zeros(len(a), bool)
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j = len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out[i] = True
    return out


def identities(lines: list[str], zones: list[int], slots: list[int]) -> tuple[list[int], list[bool]]:
    """What each line is compared by, its words or its slot; and whether it is the slot."""
    inside = sum(len(x) for x, z in zip(lines, zones) if z in (ARTICLE, NAMED))
    around = sum(len(x) for x, z in zip(lines, zones) if z == PLAIN)
    most = inside > 0 and inside >= around
    slot = [s != 0 and (z in (OUT, NAMED) or z == PLAIN and most) for s, z in zip(slots, zones)]
    return [(s if k else xxhash.xxh3_64_intdigest(x.encode())) - (1 << 63) for x, s, k in zip(lines, slots, slot)], slot


def _parser(batches):
    from matchlab.llm import pagetext as own

    for batch in batches:
        got, size = [], []
        for t in batch.column("_html").to_pylist():
            lines, zones, slots = own.page_blocks(t) if t else ([], [], [])
            ids, slot = own.identities(lines, zones, slots)
            got.append(ids)
            size.append([0 if z == own.OUT or k else len(x) for x, z, k in zip(lines, zones, slot)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("_key"), batch.column("_url"), pa.array(got, pa.list_(pa.int64())), pa.array(size, pa.list_(pa.int32()))],
            names=["_key", "_url", "hashes", "size"])


def share(a: list, a_size: list, b: list, b_size: list) -> float:
    """Part of the text of the longer page that both hold, by lines (with repeats) and their sizes."""
    left = Counter(a)
    both = 0
    for x, n in zip(b, b_size):
        if left[x] > 0:
            left[x] -= 1
            both += n
    return min(1.0, both / max(sum(a_size), sum(b_size), 1)) if a and b else 0.0


def _sharer(batches):
    from matchlab.llm import pagetext as own

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("ha", "sa", "hb", "sb")]
        yield pa.RecordBatch.from_arrays([batch.column("ra"), pa.array([own.share(*x) for x in zip(*cols)], pa.float64())], names=["ra", "share"])


def difference(text: str, other: list[int] | None) -> tuple[str, int, int, int]:
    """(main text, shared lines, lines that the difference deletes, lines that rules delete) of a
    page against the identities of the page it is compared with, or none."""
    lines, zones, slots = page_blocks(text) if text else ([], [], [])
    mine, slot = identities(lines, zones, slots)
    compared = bool(other) and other != mine
    same = common(mine, other) if compared else np.zeros(len(lines), bool)
    held = {x for x, k, s in zip(mine, slot, same) if k and s}
    same = [bool(s) or k and x in held for x, k, s in zip(mine, slot, same)]
    gone = [s and z != ARTICLE for s, z in zip(same, zones)]
    ruled = [not g and (z == OUT or z == NAMED and not compared) for g, z in zip(gone, zones)]
    kept = "\n".join(t for t, g, r in zip(lines, gone, ruled) if not g and not r)
    return kept, sum(same), sum(gone), sum(ruled)


def _differ(batches):
    from matchlab.llm import pagetext as own

    for batch in batches:
        got = [own.difference(t, o) for t, o in zip(batch.column("_html").to_pylist(), batch.column("other").to_pylist())]
        counts = [pa.array([g[k] for g in got], pa.int64()) for k in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array([g[0] for g in got], pa.string()), *counts],
                                         names=["_id", "_url", "text", "n_shared", "n_deleted", "n_ruled"])


#: Line hashes of neighbours that may be broadcast (8 bytes each); beyond it the pages are
#: joined to them by shuffle.
BROADCAST_LINES = 4_000_000


def _beyond_copies(n: DataFrame) -> DataFrame:
    """``n`` (host, path, _key, next, share) with ``back`` and ``ahead``: the last row before the row of
    copies that a path stands in, and the row at its end (whose ``next`` is the first one after).

    A row ends where the next one isn't a copy. Inside a range, windows find the ends; the ends of
    whole ranges, one row per task, close the gaps, as in ``with_next``."""
    me = F.struct("host", "path", "_key", "next")
    keys = ["host", "path", "_key"]
    r = n.withColumn("end", F.when(F.coalesce("share", F.lit(0.0)) < COPY, me))
    r = written(r.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "page-ranges")
    first = Window.unboundedPreceding
    up = Window.partitionBy("_part").orderBy(*keys).rowsBetween(first, -1)
    down = Window.partitionBy("_part").orderBy(*[F.desc(c) for c in keys]).rowsBetween(first, 0)
    ends = r.groupBy("_part").agg(F.min("end").alias("least"), F.max("end").alias("most"))
    ends = ends.select("_part", F.last("most", True).over(Window.orderBy("_part").rowsBetween(first, -1)).alias("_back"),
                       F.last("least", True).over(Window.orderBy(F.desc("_part")).rowsBetween(first, -1)).alias("_ahead"))
    r = r.withColumn("back", F.last("end", True).over(up)).withColumn("ahead", F.last("end", True).over(down)).join(ends, "_part", "left")
    return r.select(*n.columns, F.coalesce("back", "_back").alias("back"), F.coalesce("ahead", "_ahead").alias("ahead"))


def _neighbours(p: DataFrame) -> DataFrame:
    """(host, path, other): the key of the page that a path is compared with, the nearest of the host
    beyond its copies."""
    paths = p.where("host <> ''").groupBy("host", "path").agg(F.min("_key").alias("_key"))
    n = written(with_next(paths, ["host", "path", "_key"]), "page-paths")
    one = p.groupBy("_key").agg(F.first(F.struct("hashes", "size")).alias("l"))
    two = n.where("next.host = host").select(F.col("_key").alias("ra"), F.col("next._key").alias("rb"))
    two = two.join(one.select(F.col("_key").alias("ra"), F.col("l.hashes").alias("ha"), F.col("l.size").alias("sa")), "ra") \
        .join(one.select(F.col("_key").alias("rb"), F.col("l.hashes").alias("hb"), F.col("l.size").alias("sb")), "rb")
    shares = arrow_map(two.select("ra", "ha", "sa", "hb", "sb"), _sharer, "ra long, share double")
    n = written(n.join(shares.withColumnRenamed("ra", "_key"), "_key", "left").select("host", "path", "_key", "next", "share"), "page-pairs")

    def pair(rows, path, to, other, before, rank):
        return rows.select("host", F.col(path).alias("path"), F.col(to).alias("to"), F.col(other).alias("other"),
                           F.lit(before).alias("before"), F.lit(rank).alias("rank"))
    far = written(_beyond_copies(n), "page-beyond")
    alike = n.where(F.col("share").between(COPY, ONLY_COPY))
    both = pair(far.where("ahead.next.host = host"), "path", "ahead.next.path", "ahead.next._key", 0, 1) \
        .unionByName(pair(far.where("back.host = host"), "path", "back.path", "back._key", 1, 1)) \
        .unionByName(pair(alike, "path", "next.path", "next._key", 0, 0)) \
        .unionByName(pair(alike, "next.path", "path", "_key", 1, 0))
    # length of the common prefix: characters before the first place that differs
    z = F.arrays_zip(F.split("path", "").alias("x"), F.split("to", "").alias("y"))
    least = F.array_position(F.transform(z, lambda c: c["x"].eqNullSafe(c["y"])), F.lit(False))
    both = both.withColumn("like", F.when(least == 0, 1 << 30).otherwise(least))
    return both.groupBy("host", "path").agg(F.max_by("other", F.struct("rank", "like", "before")).alias("other"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_shared (lines that the page it is
    compared with holds too), n_deleted (those of them that go) and n_ruled (lines that go by rule).

    Pages are read twice: once for the hashes of their lines, and once to cut them. Between
    the two only hashes move. A page is known by a hash of its id, url and html."""
    d = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    d = d.withColumn("_key", F.xxhash64("_id", "_url", "_html"))
    kind = d.schema["_id"].dataType.simpleString()
    p = arrow_map(d.select("_key", "_url", "_html"), _parser, "_key long, _url string, hashes array<long>, size array<int>")
    after = F.regexp_replace(F.coalesce("_url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "//")
    host = F.lower(F.regexp_extract(after, r"^//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_extract(after, r"^//[^/?#]*([^?#]*)", 1), r"/+$", "")
    p = written(p.select("_key", host.alias("host"), path.alias("path"), "hashes", "size"), "page-lines")
    near = _neighbours(p)
    one = p.groupBy("_key").agg(F.first("hashes").alias("_other")).withColumnRenamed("_key", "other")
    other = near.join(one, "other").drop("other")
    mine = p.select("_key", "host", "path").distinct().join(other, ["host", "path"])
    mine = written(mine.select("_key", F.col("_other").alias("other")), "page-neighbours")
    lines = mine.agg(F.sum(F.size("other") + 2)).first()[0] or 0
    out = d.join(F.broadcast(mine) if lines <= BROADCAST_LINES else mine, "_key", "left")
    out = arrow_map(out.select("_id", "_url", "_html", "other"), _differ, f"_id {kind}, _url string, text string, n_shared long, n_deleted long, n_ruled long")
    return out.select(F.col("_id").alias("page_id"), F.col("_url").alias("url"), "text", "n_shared", "n_deleted", "n_ruled")
