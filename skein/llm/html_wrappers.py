"""HTML extraction by union-free regular expressions inferred for each host.

A page is a stream of tags and texts, nested through its tags.  The wrapper of a host starts as
its first page and is aligned with the next ones: equal tags pair up in order, a tag that
only one side has becomes optional, neighbouring equal groups (of up to three tags) become
one repeated group, and texts that differ become text slots.  Wrappers of one host merge the
same way, so every task infers from its own pages and a host's few partial wrappers meet in
one group; all pages take part and a hot host sends one wrapper for each task.

The wrapper names the host's main region: the ``article`` or ``main`` region with the most slot
text; without one, the region below ``body`` that still holds most of the slot text.  A
page's main text is the text of that region (of the page's own best region, where it lacks
it) without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments.  Outside an article, texts that every page of the host has in the same place
go too, if the host has at least ``SEVERAL`` different pages; a text that is optional or under an
optional tag stays, and a page that holds nothing else keeps all of its text.

Pages and wrappers stay bounded: tags nested deeper than ``DEEP`` belong to the region at that depth
(their texts are kept), lists of over ``EXACT`` pairs of children are aligned greedily instead of by
the longest common subsequence, and optional children of one key beyond ``MANY`` become one.

Defined cases: null or empty html has no text; markup may be cut off, unbalanced, upper
case or nested to any depth; a null or hostless url is a host of its own; repeated pages are repeated;
an empty table gives no rows.  Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import bisect
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sized, small
from .language_id import host_of

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
LEFT_OUT = frozenset("head nav footer aside form script style noscript template iframe svg math button select textarea title dialog menu object canvas audio video".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav share sharing social related recommended comment comments respond reply replies disqus header masthead footer "
    "widget newsletter subscribe subscription toolbar pagination pager login signup search skip tags".split()
)
KEPT_HEADS = frozenset("article main section".split())

#: depth of a page's tree, pairs of children that are aligned exactly, children of a wrapper's node
DEEP, EXACT, MANY = 100, 40_000, 400
#: different pages from which a text that all of them share counts as the host's own
SEVERAL = 5


class Page:
    """Texts of a page in order: (path of keys, left out, text, starts a new block)."""

    def __init__(self, source: str | None):
        self.texts: list[tuple[tuple[str, ...], bool, str, bool]] = []
        source = source or ""
        # of each open tag: name, left out, inside a kept head, place of the nearest p that a block would end
        stack: list[tuple[str, bool, bool, int]] = []
        opened: Counter = Counter()
        path: tuple[str, ...] = ()
        fresh, at = True, 0

        def pop_to(depth: int) -> None:
            nonlocal path
            opened.subtract(entry[0] for entry in stack[depth:])
            del stack[depth:]
            path = path[:depth]

        while at < len(source):
            tag = _TAG.search(source, at)
            end = tag.start() if tag else len(source)
            if end > at:
                self.texts.append((path, bool(stack) and stack[-1][1], html.unescape(source[at:end]), fresh))
                fresh = False
            if not tag:
                break
            at = tag.end()
            name = (tag[2] or tag[5] or "").lower()
            if not name:
                continue
            closing, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
            fresh = fresh or name not in INLINE
            if closing:
                if opened[name]:
                    pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                continue
            if name in RAW and not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
                at = close.end() if close else len(source)
                continue
            if name in VOID or attributes.endswith("/") and name not in ENDS_P:
                continue
            if name in ENDS_P:
                if stack and stack[-1][3] >= 0:
                    pop_to(stack[-1][3])
            elif name in SIBLINGS:
                ends, scope = SIBLINGS[name]
                for i in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEP), -1):
                    if i < len(stack) and stack[i][0] in ends:
                        pop_to(i)
                    elif i < len(stack) and stack[i][0] in scope:
                        break
            above = stack[-1] if stack else ("", False, False, -1)
            key, out = self._key(name, attributes, above[2])
            nearest = len(stack) if name == "p" else -1 if name in ("td", "th", "button", "object") else above[3]
            stack.append((name, out or above[1], above[2] or name in KEPT_HEADS, nearest))
            opened[name] += 1
            if len(path) < DEEP and len(path) == len(stack) - 1:
                path = (*path, key)

    @staticmethod
    def _key(name: str, attributes: str, inside: bool) -> tuple[str, bool]:
        out, label = name in LEFT_OUT or name == "header" and not inside, ""
        for kind, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
            kind, value = kind.lower(), next(filter(None, values), "").lower()
            if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "role" and value in LEFT_OUT_ROLES:
                out = True
            elif kind in ("class", "id") and name not in ("html", "body"):
                parts = re.split(r"[\s_]+|-", value)
                out = out or name not in ("article", "main") and not LEFT_OUT_WORDS.isdisjoint(parts)
                if kind == "class" and value and not label:
                    label = "." + re.sub(r"\d+", "", value.split()[0])
        return name + label, out

    def text(self, wanted) -> str:
        """The texts for which ``wanted(path, left out, text)`` holds; blocks are separated by one space."""
        out = []
        parted = False
        for path, left_out, text, fresh in self.texts:
            parted = parted or fresh
            if wanted(path, left_out, text):
                out.append(" " + text if parted else text)
                parted = False
        return " ".join("".join(out).split())


# A wrapper node is [key, optional, repeated, constant text or None for a slot, slot characters, children];
# texts are nodes of key "#text".


def page_tree(page: Page) -> list:
    """The page as a wrapper without options; texts that are left out are left out here too."""
    root = ["", False, False, "", 0, []]
    last: list[list] = [root]
    previous: tuple[str, ...] = ()
    for path, out, text, fresh in page.texts:
        text = " ".join(text.split())
        if out or not text:
            continue
        same = 0
        while same < min(len(path), len(previous)) and path[same] == previous[same]:
            same += 1
        if fresh and same == len(path) and path and path == previous:
            same -= 1
        del last[same + 1 :]
        for key in path[same:]:
            last[-1][5].append(node := [key, False, False, "", 0, []])
            last.append(node)
        last[-1][5].append(["#text", False, False, text, 0, []])
        previous = path
    return _collapse(root)


def _collapse(node: list) -> list:
    """Repeated neighbouring groups of up to three tags become one repeated group."""
    children: list[list] = []
    for child in map(_collapse, node[5]):
        children.append(child)
        for period in (1, 2, 3):
            one, two = children[-2 * period : -period], children[-period:]
            if len(one) == period and [c[0] for c in one] == [c[0] for c in two]:
                merged = [merge(x, y) for x, y in zip(one, two)]
                for m in merged:
                    m[2] = True
                children[-2 * period :] = merged
                break
    return [*node[:5], children]


def _aligned(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of equal keys, ascending on both sides."""
    n, m = len(left), len(right)
    head = 0
    while head < min(n, m) and left[head] == right[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and left[n - 1 - tail] == right[m - 1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(head)]
    rows, columns = n - head - tail, m - head - tail
    if rows * columns > EXACT:
        places: dict[str, list[int]] = {}
        for j in range(head, m - tail):
            places.setdefault(right[j], []).append(j)
        j = head
        for i in range(head, n - tail):
            own = places.get(left[i], [])
            at = bisect.bisect_left(own, j)
            if at < len(own):
                pairs.append((i, own[at]))
                j = own[at] + 1
    elif rows and columns:
        best = [[0] * (columns + 1) for _ in range(rows + 1)]
        for i in range(rows - 1, -1, -1):
            for j in range(columns - 1, -1, -1):
                best[i][j] = 1 + best[i + 1][j + 1] if left[head + i] == right[head + j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < rows and j < columns:
            if left[head + i] == right[head + j]:
                pairs.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return pairs + [(n - k, m - k) for k in range(tail, 0, -1)]


def merge(a: list, b: list) -> list:
    """Aligns two wrappers of one key."""
    out = [a[0], a[1] or b[1], a[2] or b[2], a[3] if a[3] == b[3] else None, a[4] + b[4], []]
    if a[0] == "#text" and out[3] is None:
        out[4] += (len(a[3]) if a[3] is not None else 0) + (len(b[3]) if b[3] is not None else 0)
    left, right = a[5], b[5]
    x = y = 0
    for i, j in [*_aligned([c[0] for c in left], [c[0] for c in right]), (len(left), len(right))]:
        out[5] += [[c[0], True, *c[2:]] for c in (*left[x:i], *right[y:j])]
        if i < len(left):
            out[5].append(merge(left[i], right[j]))
        x, y = i + 1, j + 1
    if len(out[5]) > MANY:
        out[5] = _generalised(out[5])
    return out


def _generalised(children: list[list]) -> list[list]:
    """Optional children of one key become one optional repeated child, where the first of them stood."""
    kept: list[list] = []
    first: dict[str, int] = {}
    for c in children:
        if not c[1]:
            kept.append(c)
        elif c[0] in first:
            kept[first[c[0]]] = merge(kept[first[c[0]]], c)
            kept[first[c[0]]][2] = True
        else:
            first[c[0]] = len(kept)
            kept.append(c)
    return kept


def regex(node: list) -> str:
    """The wrapper as a union-free regular expression over tags, constants and slots."""
    if node[0] == "#text":
        body = "(.+)" if node[3] is None else re.escape(node[3])
    else:
        inside = "".join(map(regex, node[5]))
        body = f"<{node[0]}>{inside}</{node[0].split('.')[0]}>" if node[0] else inside
    mark = "*" if node[1] and node[2] else "+" if node[2] else "?" if node[1] else ""
    return f"({body}){mark}" if mark else body


def _has_slots(node: list) -> bool:
    return node[3] is None if node[0] == "#text" else any(map(_has_slots, node[5]))


def main_region(wrapper: list, different: int = SEVERAL) -> tuple[list[str], list[list[str]], bool]:
    """(path of the main region, paths of the texts that all pages share, whether it is an article or main region)."""
    found: list[tuple[int, list[str]]] = []
    constants: list[list[str]] = []
    # few different pages do not tell constants from text, equal pages have no slots: constants are their text
    weight = 100 if different >= SEVERAL and _has_slots(wrapper) else 1

    def volume(node: list, path: list[str], optional: bool) -> int:
        optional = optional or node[1]
        if node[0] == "#text":
            if node[3] is not None and not optional:
                constants.append([*path, node[3]])
            return node[4] + len(node[3] or "") // weight
        here = [*path, node[0]] if node[0] else path
        total = sum(volume(c, here, optional) for c in node[5])
        node.append(total)
        if node[0].split(".")[0] in ("article", "main"):
            found.append((total, here))
        return total

    volume(wrapper, [], False)
    if found:
        top = max(v for v, _ in found)
        return max((p for v, p in found if v >= 0.8 * top), key=len), constants, True
    path: list[str] = []
    node = wrapper
    while True:
        children = [c for c in node[5] if c[0] != "#text"]
        child = max(children, key=lambda c: c[6], default=None)
        if child is None or child[6] < 0.7 * node[6] or child[0].split(".")[0] in ("p", "h1", "h2", "li", "td"):
            return path, constants, False
        path.append(child[0])
        node = child


def extract(page: Page, region: list[str], constants: frozenset[tuple[str, ...]], semantic: bool) -> str:
    if not any(not out and list(path[: len(region)]) == region for path, out, _, _ in page.texts):
        region, _, semantic = main_region(page_tree(page))
        constants = frozenset()
    k, want = len(region), tuple(region)

    def inside(path: tuple[str, ...], out: bool, text: str) -> bool:
        return not out and path[:k] == want

    def wanted(path: tuple[str, ...], out: bool, text: str) -> bool:
        return inside(path, out, text) and (*path, " ".join(text.split())) not in constants

    return page.text(inside) if semantic or not constants else page.text(wanted) or page.text(inside)


def _content(tree: list) -> int:
    """A hash of the tags and texts of a page that are not left out."""
    return xxhash.xxh3_64_intdigest(json.dumps(tree).encode("utf-8", "surrogatepass"))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partial wrapper of each host that the task has seen, with the hashes of up to ``SEVERAL`` different pages."""
    wrappers: dict[str, tuple[list, int, set[int]]] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(wrappers), pa.string()),
                pa.array([json.dumps(w) for w, _, _ in wrappers.values()], pa.string()),
                pa.array([n for _, n, _ in wrappers.values()], pa.int64()),
                pa.array([json.dumps(sorted(seen)) for _, _, seen in wrappers.values()], pa.string()),
            ],
            names=["host", "wrapper", "pages", "different"],
        )

    for b in small(batches):
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            tree = page_tree(Page(source))
            known, n, seen = wrappers.get(host) or (None, 0, set())
            if len(seen) < SEVERAL:
                seen.add(_content(tree))
            wrappers[host] = tree if known is None else merge(known, tree), n + 1, seen
        if len(wrappers) > 2_000:
            yield rows()
            wrappers = {}
    yield rows()


def _merge_host(table: pa.Table) -> pa.Table:
    wrapper, pages, seen = None, 0, set()
    for one, n, different in sorted(zip(*(table.column(c).to_pylist() for c in ("wrapper", "pages", "different")))):
        one = json.loads(one)
        wrapper, pages = one if wrapper is None else merge(wrapper, one), pages + n
        seen.update(json.loads(different))
    expression = regex(wrapper)
    region, constants, semantic = main_region(wrapper, len(seen))
    rule = {"region": region, "semantic": semantic, "constants": constants if len(seen) >= SEVERAL and not semantic else []}
    return pa.table({"host": table.column("host").slice(0, 1), "pages": pa.array([pages], pa.int64()), "wrapper": [expression], "rule": [json.dumps(rule)]})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules: dict[str, tuple[list[str], frozenset, bool]] = {}
    for b in small(batches):
        texts = []
        for source, rule in zip(b.column("html").to_pylist(), b.column("rule").to_pylist()):
            if rule not in rules:
                r = json.loads(rule) if rule else {"region": ["\0"], "constants": [], "semantic": False}
                if len(rules) > 5_000:
                    rules.clear()
                rules[rule] = r["region"], frozenset(map(tuple, r["constants"])), r["semantic"]
            texts.append(extract(Page(source), *rules[rule]))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper, rule): the union-free expression and the extraction rule of every host."""
    rows = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "html")
    return rows.mapInArrow(_infer, "host string, wrapper string, pages long, different string").groupBy("host").applyInArrow(_merge_host, "host string, pages long, wrapper string, rule string")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rules = cut(host_wrappers(pages).select(F.col("host").alias("_host"), "rule"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("_host"))
    return rows.join(sized(rules), "_host", "left").select("page_id", "url", "html", "rule").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
