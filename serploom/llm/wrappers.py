"""HTML extraction by union-free wrappers of a host's pages.

Each page becomes a token stream: opening tags with their class words, closing tags, and slots for text. Runs
of equal blocks are folded into repeated groups ``(...)+``. The streams of one host are aligned one after the
other: equal tokens stay, a group takes in what repeats it, and what stands in one stream only becomes an
optional group ``(...)?``. The result is a regular expression without unions, the host's wrapper. Its text
slots carry the text they held over all pages, which shows the element that holds the main text: an article
(or main) element if the wrapper has one, else the deepest element that holds most of the running text.
A page's main text is what stands in that element, without the slots of menus, headers, footers, sidebars,
notices, adverts, forms and comments; a page that lacks the element is read whole, less those slots.

Equal streams are counted before the shuffle; the distinct streams of a host are aligned in blocks whose
wrappers are aligned in turn, so no task holds all of a host.

Text: character references decoded, white space inside a block made one space, blocks joined by one newline.
Headings of a header inside the article stay. Defined results: a null or empty page has empty text; a url
without a host belongs to the host ''; unclosed and stray tags are tolerated; repeated rows are read each by
itself; extra columns stay untouched.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import fresh, landed

#: streams aligned by one task at a time, and wrappers of hosts that may be broadcast
BLOCK = 64
BROADCAST_HOSTS = 20_000
#: an element holds the main text if it has this share of the running text
MAIN_SHARE = 0.7
#: longest block of tokens that is tried as a repeated group
PERIOD = 16

#: element names and class or id words of page furniture (fixed values)
FURNITURE_TAGS = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas audio video button select option "
                           "textarea input dialog head title menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
                            "notice notices notification newsletter subscribe subscription signup sidebar aside nav navbar navigation menu "
                            "breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond reply replies share sharing social "
                            "related recommended recommendations popup modal overlay login search pagination pager toolbar widget skip".split())
CONTENT_WORDS = frozenset("article content post entry story main body text page wrapper container".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                       "h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: an opening tag closes open elements of these names, up to the nearest of the others
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
ROOT_TAGS = ("article", "main")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.DOTALL)
_RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def events(page: str):
    """('open', tag, label, furniture), ('close', tag), ('text', text) of a page in order."""
    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        if not m:  # a tag that never ends
            break
        at = m.end()
        if m[4] is not None:
            yield "text", m[4], "", False
        elif m[2]:
            tag = m[2].lower()
            if m[1]:
                yield "close", tag, "", False
                continue
            found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(m[3])}
            words = [w.lower() for k in ("class", "id") for w in _CLASS_WORD.findall(found.get(k, ""))]
            label = ".".join([tag, *found.get("class", "").split()]) + (f"#{found['id']}" if found.get("id") else "")
            off = tag in FURNITURE_TAGS or found.get("role", "").lower() in FURNITURE_ROLES
            if tag not in ("html", "body", *ROOT_TAGS) or "comment" in words or "comments" in words:
                off = off or any(w in FURNITURE_WORDS for w in words) and not (any(w in CONTENT_WORDS for w in words) and tag != "article")
            yield "open", tag, label, off
            if tag in _RAW and not m[3].endswith("/"):
                end = _RAW[tag].search(page, at)
                yield "close", tag, "", False
                at = end.end() if end else len(page)


class Elements:
    """The open elements: tag, label, and whether they are furniture."""

    def __init__(self):
        self.open: list[tuple[str, str, bool]] = []

    def _close(self, names: set, until: set) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                del self.open[k:]
                return
            if self.open[k][0] in until:
                return

    def enter(self, tag: str, label: str, off: bool) -> None:
        if tag in BLOCK_TAGS:
            self._close({"p"}, {"button", "table", "td", "th", "article", "section", "div", "body", "li", "blockquote"} - {"p"})
        if tag in IMPLIED_END:
            self._close(*IMPLIED_END[tag])
        if tag == "header":  # a page's header; one inside the article keeps its headings
            off = True
        if tag in HEADINGS and any(t in ROOT_TAGS for t, _, _ in self.open):
            heads = [k for k, (t, _, _) in enumerate(self.open) if t == "header"]
            roots = [k for k, (t, _, _) in enumerate(self.open) if t in ROOT_TAGS]
            if heads and heads[0] > roots[0] and not any(f and t != "header" for t, _, f in self.open):
                self.open.append((tag, "!" + label, False))
                return
        if tag not in VOID_TAGS:
            self.open.append((tag, label, off))

    def leave(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    @property
    def furniture(self) -> bool:
        kept = any(label.startswith("!") for _, label, _ in self.open)
        return any(off and not (kept and tag == "header") for tag, _, off in self.open)

    @property
    def path(self) -> str:
        return "/".join(label for _, label, _ in self.open)


def fold(nodes: list) -> list:
    """Runs of equal blocks become repeated groups ['+', ...]."""
    nodes = list(nodes)
    for period in range(1, PERIOD + 1):
        out, i = [], 0
        while i < len(nodes):
            block = nodes[i : i + period]
            if len(block) == period and block == nodes[i + period : i + 2 * period] and not (period == 1 and isinstance(block[0], list)):
                j = i + 2 * period
                while nodes[j : j + period] == block:
                    j += period
                out.append(["+", *block])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        # a group takes in a block before or behind it that repeats it
        merged: list = []
        for node in out:
            if merged and isinstance(node, list) and merged[-1] == node:
                continue
            merged.append(node)
            group = merged[-1]
            if isinstance(group, list) and group[0] == "+":
                body = group[1:]
                while len(merged) > len(body) and merged[-1 - len(body) : -1] == body:
                    del merged[-1 - len(body) : -1]
        nodes = merged
    return nodes


def align(a: list, b: list) -> list:
    """One wrapper of two: mismatches become repeated or optional groups."""
    key = lambda n: n if isinstance(n, str) else json.dumps(n[1:] if n[0] == "?" else n)
    out: list = []

    def optional(part: list) -> list:
        return [n if isinstance(n, list) and n[0] == "?" else ["?", n] if isinstance(n, str) else ["?", *([n] if n[0] == "+" else n[1:])] for n in part]

    ka, kb = [key(n) if isinstance(n, str) or n[0] != "?" or len(n) > 2 else key(n[1]) for n in a], [key(n) if isinstance(n, str) or n[0] != "?" or len(n) > 2 else key(n[1]) for n in b]
    for op, i, j, k, m in difflib.SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        left, right = a[i:j], b[k:m]
        if op == "equal":
            out += [y if isinstance(y, list) and y[0] == "?" else x for x, y in zip(left, right, strict=True)]
            continue
        # one side repeats what the other has once
        for one, other in ((left, right), (right, left)):
            if len(one) == 1 and isinstance(one[0], list) and one[0][0] == "+" and one[0][1:] == other:
                out += one
                break
        else:
            out += optional(left) + optional(right)
    return fold(out)


def as_expression(nodes: list) -> str:
    """A wrapper as text, e.g. ``<p> # </p>`` groups with + and ?."""
    return " ".join(n if isinstance(n, str) else f"({as_expression(n[1:])}){n[0]}" for n in nodes)


def summary(page: str) -> tuple[str, list[tuple[str, int, int]]]:
    """Folded token stream as JSON, and per slot path outside furniture: characters, characters in links."""
    stack, stream, slots = Elements(), [], {}
    for kind, a, label, off in events(page):
        if kind == "open":
            stack.enter(a, label, off)
            stream.append(f"<{label}>")
        elif kind == "close":
            stack.leave(a)
            stream.append(f"</{a}>")
        elif not a.isspace():
            if stream and stream[-1] != "#":
                stream.append("#")
            if not stack.furniture:
                own = slots.setdefault(stack.path, [0, 0])
                own[0] += len(a)
                own[1] += len(a) * any(t == "a" for t, _, _ in stack.open)
    return json.dumps(fold(stream)), [(p, x, y) for p, (x, y) in slots.items()]


def root_of(wrapper: list, slots: list[tuple[str, int, int]]) -> str:
    """Label path of the element that holds the main text; a bare name for an article or main element."""
    names = lambda path: [part.split(".")[0].split("#")[0] for part in path.split("/")]
    known = as_expression(wrapper)
    for root in ROOT_TAGS:
        if f"<{root}" in known and any(root in names(path) for path, chars, _ in slots if chars):
            return root
    mass: dict[str, int] = {}
    for path, chars, linked in slots:
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            if names(parts[k - 1])[0] in ("p", "b", "i", "em", "strong", "a", "span", "li", "ul", "ol", *HEADINGS):
                break
            prefix = "/".join(parts[:k])
            mass[prefix] = mass.get(prefix, 0) + max(0, chars - 2 * linked)
    total = sum(max(0, x - 2 * y) for _, x, y in slots)
    good = [p for p, x in mass.items() if x >= MAIN_SHARE * total]
    return max(good, key=lambda p: (p.count("/"), p), default="")


def main_text(page: str, root: str) -> str:
    """Main text of a page, read in the root's element if the page has it."""
    stack = Elements()
    inside_blocks: list[str] = []
    whole_blocks: list[str] = []
    piece: list[str] = []
    state = False

    def flush() -> None:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            whole_blocks.append(text)
            if state:
                inside_blocks.append(text)

    def inside() -> bool:
        if not root:
            return True
        if root in ROOT_TAGS:
            return any(t == root for t, _, _ in stack.open)
        return f"{stack.path}/".startswith(f"{root}/")

    for kind, a, label, off in events(page):
        if kind == "text":
            if not stack.furniture:
                piece.append(entities.unescape(a))
            continue
        if a in BLOCK_TAGS:
            flush()
        elif a == "br":
            piece.append(" ")
        if kind == "open":
            stack.enter(a, label, off)
        else:
            stack.leave(a)
        if (now := inside()) != state:
            flush()
            state = now
    flush()
    return "\n".join(inside_blocks or whole_blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """One row per host: host, n_pages, wrapper (the expression), root (path of the element with the main text)."""
    span = pa.struct([("path", pa.string()), ("chars", pa.int64()), ("linked", pa.int64())])

    @F.arrow_udf(returnType="struct<stream:string,slots:array<struct<path:string,chars:bigint,linked:bigint>>>")
    def summed(values: pa.Array) -> pa.Array:
        found = [summary(v.as_py() or "") for v in values]
        slots = [[{"path": p, "chars": x, "linked": y} for p, x, y in s] for _, s in found]
        return pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.string()), pa.array(slots, pa.list_(span))], names=["stream", "slots"])

    each = pages.select(host_of(F.col(url)).alias("host"), summed.asNondeterministic()(F.col(page)).alias("s"))
    # the skeleton table is small: what differs between pages is in their texts
    streams = landed(
        each.select("host", "s.stream", "s.slots").groupBy("host", "stream", "slots").agg(F.count("*").alias("n")), "wrapper-streams"
    )
    slots = streams.select("host", "n", F.explode("slots").alias("x")).groupBy("host", "x.path").agg(
        F.sum(F.col("x.chars") * F.col("n")).alias("chars"), F.sum(F.col("x.linked") * F.col("n")).alias("linked")
    )
    level = streams.groupBy("host", "stream").agg(F.sum("n").alias("n"))
    while True:
        counted = level.groupBy("host").agg(F.count("*").alias("k"))
        most = counted.agg(F.max("k")).first()[0] or 0
        dealt = level.join(counted, "host").withColumn("block", F.pmod(F.xxhash64("stream"), F.ceil(F.col("k") / BLOCK)))

        def merged(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("n", "descending"), ("stream", "ascending")])
            wrapper: list = []
            for k, s in enumerate(rows["stream"].to_pylist()):
                wrapper = align(wrapper, json.loads(s)) if k else json.loads(s)
            return pa.table({"host": rows["host"][:1], "stream": pa.array([json.dumps(wrapper)]), "n": pa.array([sum(rows["n"].to_pylist())], pa.int64())})

        level = landed(dealt.select("host", "block", "stream", "n").groupBy("host", "block").applyInArrow(merged, "host string, stream string, n bigint"), "wrapper-level")
        if most <= BLOCK:
            break

    def root(rows: pa.Table) -> pa.Table:
        wrapper = json.loads(rows["stream"][0].as_py())
        slots = [(p, x, y) for p, x, y in zip(rows["path"].to_pylist(), rows["chars"].to_pylist(), rows["linked"].to_pylist(), strict=True) if p is not None]
        return pa.table({"host": rows["host"][:1], "n_pages": rows["n"][:1], "wrapper": pa.array([as_expression(wrapper)]), "root": pa.array([root_of(wrapper, slots)])})

    joined = level.join(slots, "host", "left").select("host", "stream", "n", "path", "chars", "linked")
    return joined.groupBy("host").applyInArrow(root, "host string, n_pages bigint, wrapper string, root string")


def with_main_text(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of each page by its host's wrapper."""
    roots = landed(wrappers(pages, url, page).select("host", "root"), "wrapper-roots")
    host, of, root = fresh(pages, "host", "of", "root")
    roots = roots.select(F.col("host").alias(of), F.col("root").alias(root))
    small = F.broadcast(roots) if roots.count() <= BROADCAST_HOSTS else roots

    @F.arrow_udf(returnType="string")
    def extracted(values: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array([main_text(v.as_py() or "", r.as_py() or "") for v, r in zip(values, at, strict=True)], pa.string())

    joined = pages.withColumn(host, host_of(F.col(url))).join(small, F.col(host) == F.col(of), "left")
    return joined.withColumn(out, extracted.asNondeterministic()(F.col(page), F.col(root))).drop(host, of, root)
