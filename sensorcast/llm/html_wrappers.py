"""Main text of web pages by union-free wrappers inferred per host.

A page is read as a stream of tags and texts. The wrapper of a host is a regular expression over such streams without
unions: groups, each of them optional, repeated, both or neither, and slots for texts. Pages are aligned one by one (where
they are read; then the wrappers per host and part, then those per host): a text that differs makes its slot variable,
a group that only some pages have becomes optional, and groups that pages have in different numbers become one
repeated group. A wrapper grows with the variety of a host's markup, not with its pages. At last each page is aligned with
the wrapper of its host; a text that meets a slot that never varied over several distinct pages is template text.

Slots that no content belongs to (menus, headers, footers, notices, adverts, forms, scripts,
comments of readers) are told by the groups around them. Of the slots that are left, a page that has most of
its text in an article (or a main group) is read there only, and any other page in all of them but template text.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorcast.staging import stage

PARTS = 16  # parts of a host that are merged apart from each other
HOSTS = 2_000  # hosts whose wrappers a task holds before it passes them on

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
# Elements that an opening tag ends, if they are open in the same block.
ENDED = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
P_ENDERS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section table ul".split()
)
# Elements and names of classes that hold no article text.
OUTSIDE = frozenset(
    "head title script style noscript template nav header footer aside form button select option textarea iframe svg "
    "menu dialog input noembed noframes object".split()
)
OUTSIDE_NAME = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|nav\w*|breadcrumbs?|side-?bar|footer|masthead|comments?|disqus|cookies?\w*|gdpr|"
    r"popup|modal|newsletter)(?:$|[_-])",
    re.IGNORECASE,
)
# Words that an article may be about as well: they count where a group is named by nothing but such words and
# plain words for parts of a page.
DOUBTFUL = frozenset("promo promos promotion banner menu replies consent notice subscribe share social related widget".split())
PLAIN = frozenset(
    "area articles bar block box button buttons buttonbar container content links list inner item items panel posts section "
    "signup site top bottom left right wrap wrapper widgets".split()
)
# What a class tells of the state of a page, as has-sidebar or nav-open: it names no menu.
STATE = re.compile(r"^(?:has|no|with|without|is|js)[_-]|[_-](?:open|closed|less|free|hidden|visible|enabled|disabled|active|layout|page)$", re.IGNORECASE)
# Groups that hold the article, whatever they are called.
WHOLE = frozenset("html body main article".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.DOTALL
)
# A quote opens a value only after an equals sign.
_ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+)))?""")
_TELLING = re.compile("class|id|role|hidden", re.IGNORECASE)
SLOT = "#text"
SUPPORT = 3  # distinct pages that must share a text before it is taken for template text
DEEP = 120  # groups in a path; deeper ones, as of tags that are never closed, are not told apart


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): "text" with its characters decoded, "open" with the attributes, "close"."""
    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        begin = found.start() if found else end
        if begin > at:
            yield "text", "", html.unescape(page[at:begin])
        if not found:
            return
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            yield "close", name, ""
            continue
        yield "open", name, found[3]
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            stop = close.start() if close else end
            if stop > at:
                yield "text", "", page[at:stop]
            at = stop


def _label(name: str, attributes: str) -> str:
    if not attributes or not _TELLING.search(attributes):
        return name
    names, hidden = [], False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id", "role") and value:
            names.append(value)
        hidden |= key == "hidden" or (key == "aria-hidden" and value.strip("/ ").lower() == "true")
    # Numbers in names differ between pages of one template.
    label = name + "".join("." + re.sub(r"\d+", "0", " ".join(n.split())) for n in names)
    return label + ("!hidden" if hidden else "")


def read(page: str) -> Iterator[tuple[str, tuple[str, ...], str]]:
    """Events of a page with the labels of the groups around them: ("text", path, value), ("open", path, "") for a
    group that opens, its own label last, ("break", path, "") for a line break.

    Groups deeper than DEEP stay open until they are closed, but only those that ``_tells`` names are in the path."""
    paths: list[tuple[str, ...]] = [()]
    names: list[str] = []

    def cut(depth: int) -> None:
        del paths[depth + 1 :], names[depth:]

    for kind, name, value in tokens(page):
        if kind == "text":
            yield "text", paths[-1], value
        elif kind == "close":
            if name == "br":
                yield "break", paths[-1], ""
            elif name in names:
                if len(names) > DEEP and name not in INLINE:
                    yield "break", paths[-1], ""
                cut(len(names) - 1 - names[::-1].index(name))
        elif name in VOID:
            yield ("open", (*paths[-1], name), "") if name not in ("br", "wbr") else ("break", paths[-1], "")
        else:
            if name in ("html", "body") and name in names:
                continue
            if name in P_ENDERS and "p" in names:
                at = len(names) - 1 - names[::-1].index("p")
                if all(n in INLINE for n in names[at + 1 :]):
                    cut(at)
            ends = ENDED.get(name)
            if ends:
                for at in range(len(names) - 1, -1, -1):
                    if names[at] in ends:
                        cut(at)
                        break
                    if names[at] in ("ul", "ol", "dl", "table", "select"):
                        break
            around, label = paths[-1], _label(name, value)
            paths.append((*around, label) if len(names) < DEEP or _tells(label, around) else around)
            names.append(name)
            yield "open", (*around, label), ""


def _tells(label: str, around: tuple[str, ...]) -> bool:
    """Whether a group changes what its texts are: the first one outside, or the first article or main group."""
    name = label.split(".")[0]
    if name in ("article", "main") and all(other.split(".")[0] != name for other in around):
        return True
    return shut((*around, label)) and not shut(around)


# A wrapper is a list of nodes [label, flags, signature, body]. The body of a group is its list of nodes, that of a
# text slot [pages that have it, digests of SUPPORT distinct ones, marks]. The signature is a digest of all text
# below while all pages agree, and null from the first mismatch on.
OPTIONAL, REPEATED = 1, 2


@lru_cache(65_536)
def _block(path: tuple[str, ...]) -> tuple[str, ...]:
    """The groups of a path that part texts; elements inside a line do not."""
    return tuple(label for label in path if label.partition(".")[0].removesuffix("!hidden") not in INLINE)


def tree(events: list, counted: bool = True) -> list:
    """The token stream of a page as a wrapper: groups that part texts, and slots. Groups that are outside are left out.

    A slot's marks are the places of its texts in ``events``. Pages that are only matched are not counted."""
    top: list = []
    trail: list[list] = []
    for at, (kind, path, value) in enumerate(events):
        block = _block(path)
        if kind == "open" and len(block) and len(_block(path[-1:])):
            del trail[len(block) - 1 :]
            trail.append([block[-1], None])
        elif kind == "text" and value.strip() and not shut(path):
            del trail[len(block) :]
            nodes = top
            for entry in trail:
                if entry[1] is None:
                    entry[1] = []
                    nodes.append([entry[0], 0, None, entry[1]])
                nodes = entry[1]
            if not nodes or nodes[-1][0] != SLOT:
                nodes.append([SLOT, 0, None, []])
            nodes[-1][3].append(at)
    own: list[str] = []
    sealed = _sealed(top, events, counted, own)
    if counted:
        own.append(_digest("\0".join(node[2] for node in sealed)))
    return sealed


def _sealed(nodes: list, events: list, counted: bool, own: list) -> list:
    out = []
    for label, flags, _, body in nodes:
        if label == SLOT:
            text = " ".join("".join(events[at][2] for at in body).split())
            out.append([label, flags, _digest(text), [1, own, []] if counted else [0, own, body]])
        else:
            inner = _sealed(body, events, counted, own)
            out.append([label, flags, _digest("\0".join([label, *(f"{i[0]}\0{i[2]}" for i in inner)])), inner])
    return out


def _digest(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "surrogatepass"))


def pair(a: list, b: list, within: bool = False) -> list:
    """One node for two with the same label; ``within`` tells that the same pages may have both."""
    if a[0] == SLOT:
        (n, pages, marks), (n_, pages_, marks_) = a[3], b[3]
        seen = pages if pages == pages_ else sorted({*pages, *pages_})[:SUPPORT]
        body = [max(n, n_) if within else n + n_, seen, marks + marks_]
    else:
        body = align(a[3], b[3], within)
    return [a[0], a[1] | b[1], a[2] if a[2] == b[2] else None, body]


def align(one: list, two: list, within: bool = False) -> list:
    """Both lists of nodes as one. Nodes with the same text throughout that are alone of their kind in both lists hold
    the lists together, as far as they keep their order; between them nodes meet by label, from both ends. A node left
    over meets one of its label that is left over too, or else becomes optional; ``fold`` finds what repeats."""
    out: list = []
    ends = [(-1, -1), *_anchors(one, two), (len(one), len(two))]
    mismatch = False
    for (i, j), (i_end, j_end) in zip(ends, ends[1:]):
        if i >= 0:
            out.append(pair(one[i], two[j], within))
        i, j, tail = i + 1, j + 1, []
        while i < i_end and j < j_end and one[i][0] == two[j][0]:
            out.append(pair(one[i], two[j], within))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and one[i_end - 1][0] == two[j_end - 1][0]:
            i_end, j_end = i_end - 1, j_end - 1
            tail.append(pair(one[i_end], two[j_end], within))
        if i < i_end or j < j_end:
            mismatch = True
            others: dict[str, deque] = {}
            for node in two[j:j_end]:
                others.setdefault(node[0], deque()).append(node)
            for node in one[i:i_end]:
                same = others.get(node[0])
                out.append(_marked(pair(node, same.popleft(), within) if same else node, OPTIONAL))
            out.extend(_marked(node, OPTIONAL) for same in others.values() for node in same)
        out.extend(reversed(tail))
    return fold(out) if mismatch else out


def _anchors(one: list, two: list) -> list[tuple[int, int]]:
    """Places of nodes that have one signature, alone of it in each list: the longest row of them that is in order."""
    places: dict[tuple, int] = {}
    for j, node in enumerate(two):
        if node[2] is not None:
            key = (node[0], node[2])
            places[key] = -1 if key in places else j
    count = Counter((node[0], node[2]) for node in one if node[2] is not None)
    common = [
        (i, places[node[0], node[2]])
        for i, node in enumerate(one)
        if node[2] is not None and count[node[0], node[2]] == 1 and places.get((node[0], node[2]), -1) >= 0
    ]
    ends: list[int] = []
    last: list[int] = []
    before = []
    for at, (_, j) in enumerate(common):
        k = bisect_left(ends, j)
        before.append(last[k - 1] if k else -1)
        if k == len(ends):
            ends.append(j)
            last.append(at)
        else:
            ends[k], last[k] = j, at
    chain, at = [], last[-1] if last else -1
    while at >= 0:
        chain.append(common[at])
        at = before[at]
    return chain[::-1]


def _marked(node: list, flag: int) -> list:
    return [node[0], node[1] | flag, *node[2:]]


def fold(nodes: list) -> list:
    """Repeated groups: between two nodes that all pages have alike, the nodes of a label become one repeated node if
    their texts differ and pages do not have equally many of them. (h2 p)+ is held as h2+ p+ in the order of the
    first page, so a list is no longer than its constant nodes and the labels between them."""
    out: list = []
    at = 0
    while at < len(nodes):
        if nodes[at][2] is not None and not nodes[at][1] & OPTIONAL:
            out.append(nodes[at])
            at += 1
            continue
        stretch: dict[str, list] = {}
        begin = at
        while at < len(nodes) and (nodes[at][2] is None or nodes[at][1] & OPTIONAL):
            stretch.setdefault(nodes[at][0], []).append(nodes[at])
            at += 1
        repeated = {
            label
            for label, same in stretch.items()
            if len(same) > 1 and any(node[1] for node in same) and any(node[2] is None for node in same)
        }
        for node in nodes[begin:at]:
            if node[0] not in repeated:
                out.append(node)
                continue
            same = stretch.pop(node[0], [])
            while len(same) > 1:
                last = same[len(same) & ~1 :]
                same = [pair(a, b, True) for a, b in zip(same[::2], same[1::2])] + last
            out.extend(_marked(node, REPEATED) for node in same)
    return out


def expression(wrapper: list) -> str:
    """The wrapper as a union-free regular expression over tags and texts; # is a text that varies."""
    parts = []
    for label, flags, signature, body in wrapper:
        inner = ("#" if signature is None else "text") if label == SLOT else f"<{label}>{expression(body)}</>"
        mark = ("", "?", "+", "*")[flags]
        parts.append(f"({inner}){mark}" if mark else inner)
    return "".join(parts)


@lru_cache(65_536)
def outside(label: str) -> bool:
    """Whether a group, by its own element and names, holds no article text."""
    name, _, names = label.removesuffix("!hidden").partition(".")
    if name in ("html", "body"):
        return False
    if label.endswith("!hidden") or name in OUTSIDE:
        return True
    if name in WHOLE or not names:
        return False
    own = [n for n in names.lower().replace(".", " ").split() if not STATE.search(n)]
    if any(map(OUTSIDE_NAME.search, own)):
        return True
    words = [w for n in own for w in re.split(r"[_\-\d]+", n) if w]
    return any(w in DOUBTFUL for w in words) and all(w in DOUBTFUL or w in PLAIN for w in words)


@lru_cache(65_536)
def shut(path: tuple[str, ...]) -> bool:
    """Whether any group around a text is outside. The header of an article is the article's own."""
    article = False
    for label in path:
        name = label.removesuffix("!hidden").partition(".")[0]
        if outside(label) and not (article and name == "header" and not outside("div" + label[len(name) :])):
            return True
        article |= name == "article"
    return False


# What the query holds of a host: how many pages it has, and its wrapper.


def wrapper_of(page: str) -> dict:
    return {"pages": 1, "nodes": tree(list(read(page)))}


def combine(one: dict, two: dict) -> dict:
    return {"pages": one["pages"] + two["pages"], "nodes": align(one["nodes"], two["nodes"])}


def finished(nodes: list, pages: int) -> list:
    """A wrapper to match pages with: slots are [1 if they hold template text, [], []].

    Template text is the same on all pages that have the slot, if these are at least half of the host's
    and SUPPORT of them differ elsewhere."""
    out = []
    for label, flags, signature, body in nodes:
        if label == SLOT:
            body = [int(signature is not None and len(body[1]) >= SUPPORT and 2 * body[0] >= pages), [], []]
        else:
            body = finished(body, pages)
        out.append([label, flags, signature, body])
    return out


def _template(nodes: list) -> Iterator[int]:
    """Places of a matched page's texts that met template text and are equal to it."""
    for label, _, signature, body in nodes:
        if label != SLOT:
            yield from _template(body)
        elif signature is not None and body[0]:
            yield from body[2]


def extract(page: str | None, wrapper: list) -> str:
    """Text of the page's content slots; blocks are parted by one space, white space is one space.

    The page is aligned with the finished wrapper of its host; what meets template text outside an article or main group
    is none. Content is what the page itself has in an article, or else in a main group, if that is at least half
    of its text without template text, so that a teaser card does not stand for a page; or else its text without
    template text; or else, if there is nothing else, all of it."""
    events = list(read(page or ""))
    template = set(_template(align(wrapper, tree(events, False))))
    some: list[set[int]] = [set(), set(), set(), set()]
    blank = set()
    for at, (kind, path, value) in enumerate(events):
        if kind != "text" or shut(path):
            continue
        if not value.strip():
            blank.add(at)
            continue
        names = {label.split(".")[0] for label in path}
        inside = [name in names for name in ("article", "main")]
        for part, has in zip(some, [*inside, any(inside) or at not in template, True]):
            if has:
                part.add(at)
    sizes = [sum(len(events[at][2].strip()) for at in part) for part in some]
    chosen = blank.union(next((part for part, size in zip(some, sizes) if size and 2 * size >= sizes[2]), ()))
    out: list[str] = []
    block: tuple = ()
    for at, (kind, path, value) in enumerate(events):
        around = _block(path)
        if kind == "break" or around != block or (kind == "open" and path[-1].partition(".")[0] not in INLINE):
            out.append(" ")
            block = around
        if at in chosen:
            out.append(value)
    return " ".join("".join(out).split())


def host(url: Column) -> Column:
    """Host of a URL in lower case, "" without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _merged(wrappers: Iterable[str]) -> dict:
    # In one order, whatever the shuffle made of it: which texts meet depends on the pages before them.
    return reduce(combine, map(json.loads, sorted(wrappers)))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, finished wrapper as JSON) of all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}

        def passed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())],
                names=["host", "wrapper"],
            )
            held.clear()
            return made

        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = wrapper_of(page.as_py() or "")
                held[name] = combine(held[name], own) if name in held else own
            if len(held) >= HOSTS:
                yield passed()
        yield passed()

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps(_merged(frame["wrapper"]))]})

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        made = _merged(frame["wrapper"])
        nodes = json.dumps(finished(made["nodes"], made["pages"]), separators=(",", ":"))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [nodes]})

    read_ = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    partial = read_.mapInArrow(run, "host string, wrapper string").withColumn(
        "part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS))
    )
    once = partial.groupBy("host", "part").applyInPandas(join, "host string, wrapper string")
    return once.groupBy("host").applyInPandas(last, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, n_chars in code points.

    A null or empty page has an empty text. Pages without a host in their URL share one wrapper. Tags
    that are not closed, truncated pages and unknown references are read as far as they go.
    Repeated rows are read each; null ids and URLs stay null; other columns are ignored; an empty
    table gives no rows.
    """
    found = stage(wrappers(pages), "wrappers")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        host(F.col("url")).alias("host"),
    ).join(found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column("html"), batch.column("wrapper")):
                key = wrapper.as_py()
                if key not in known:
                    if len(known) >= HOSTS:
                        known.clear()
                    known[key] = json.loads(key)
                texts.append(extract(page.as_py(), known[key]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
