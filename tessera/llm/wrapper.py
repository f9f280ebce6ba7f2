"""HTML extraction by union-free wrappers inferred for each host.

A page's token stream becomes a tree of its block elements, with a slot for each run of text. Neighbours of one label
fold into a repetition, and runs that repeat in turn (heading, paragraph, heading, paragraph) into a repeated group.
The trees of a host's distinct pages are aligned with one another, as a tree reduction of any number of them: what one
lacks becomes optional, what repeats a repeated group, and text that differs a slot. The result, the host's wrapper, is
a union-free regular expression over labels (element name and class words) in which every text is known to be
template (the same on all pages that have it) or a slot.

To extract, a page's tree is matched with its host's wrapper. The main region is all the wrapper's articles that stand in no other,
or its main elements if these hold over twice as much text; on a host without either, the deepest element that holds over half of the text that differs
between pages, so that what a host repeats on every page isn't taken for content. Within the region template text goes
too: text that is the same on at least LEAST_PAGES distinct pages and on half of them, unless such text is more than
MOST_TEMPLATE of the region, as on hosts of near copies. Elements that are furniture by name, role or class words
(FURNITURE, ROLES, CUES) go with all they hold; a class word counts only if all its hyphenated parts are such words, so
`ad-banner` counts and `share-price` doesn't. A main element within furniture, and an article within a form, a header
or an unclosed menu, shows again: such furniture holds the page. A host's only page is its own wrapper.

Bounds on shapes, none of which loses text: elements nested deeper than MOST_DEPTH stand for their ancestor at that
depth; an element with more than MOST_CHILDREN children after folding is matched by their names in any order.

Defined cases: a null page is empty and has no text; a null or malformed url belongs to the host ''; a page that lacks
its host's main region yields the text of its own; repeated rows are extracted alike; other columns pass through, and a
column bearing an output's name is replaced.
"""

from __future__ import annotations

import html as htmllib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tessera.llm.common import fresh, map_rows, materialize

#: A tag, up to the > that no quote hides; possessive, so linear. RAW_END closes the elements whose content is no markup.
TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)([^>]*+)>")
ATTR = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in ("script", "style", "textarea", "title", "iframe", "noembed", "xmp")}

#: Elements within a line of text: they neither end a block nor belong to the tree.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the key's kind closes.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote dl div fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
NAMES = INLINE | VOID | ENDS_P | frozenset("li dt dd tr td th tbody thead tfoot caption figure figcaption details summary dialog button menu svg math select object center".split())
#: Furniture by name; the second line holds what shows no text of the article.
FURNITURE = frozenset("nav header footer aside form button dialog menu head".split()) | frozenset(
    "noscript template svg math object select canvas audio video datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: Class words that mark furniture, and words that may stand beside them.
CUES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer header masthead menu"
    " modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted related share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
BESIDE = frozenset("area articles bar bars block body box bottom button buttons container content dropdown form global icons inner item items left links list main mobile page panel posts primary reply right secondary section signup site slot sticky stories text thread to top unit user wrap wrapper".split())
MAIN = ("article", "main")
#: Class words by which an article is a reader's comment or an advert.
NOT_MAIN = frozenset("ad ads advert advertisement comment comments disqus promo sponsored".split())
#: Furniture that a main element within it ends, as it was never closed or holds the whole page; for an article only the named ones.
HOLDS_ARTICLE = frozenset("nav header form menu button head dialog".split())

FAN_IN = 64
MOST_CHILDREN = 200
MOST_DEPTH = 100
LEAST_PAGES, MOST_TEMPLATE = 4, 0.3
#: Wrappers that are sent to all workers, in characters; more are joined by host and salt, MOST_GROUP characters of pages each.
MOST_SENT, MOST_GROUP = 32 << 20, 64 << 20


class Node:
    """An element, a slot (label #) or a group (label in parentheses) of a page or a wrapper.

    low, high: least and greatest hash of the text a slot has on a page; pages: how many have it; chars: in all;
    blocks: the numbers of a page's own texts; any_order: the children are matched by name.
    """

    __slots__ = ("label", "optional", "repeated", "any_order", "kids", "low", "high", "pages", "chars", "blocks")

    def __init__(self, label: str, kids: list[Node] | None = None, text: int = 0, chars: int = 0, blocks: list[int] | None = None):
        self.label, self.optional, self.repeated, self.any_order, self.kids = label, False, False, False, kids or []
        self.low = self.high = text
        self.pages, self.chars, self.blocks = 1, chars, blocks or []

    def to_list(self) -> list:
        return [self.label, int(self.optional) | 2 * self.repeated | 4 * self.any_order, [k.to_list() for k in self.kids]]

    @staticmethod
    def of_list(found: list) -> Node:
        node = Node(found[0], [Node.of_list(k) for k in found[2]])
        node.optional, node.repeated, node.any_order = bool(found[1] & 1), bool(found[1] & 2), bool(found[1] & 4)
        return node

    def walk(self) -> Iterator[Node]:
        yield self
        for k in self.kids:
            yield from k.walk()


def _is_cue(words: str, cues: frozenset[str] = CUES) -> bool:
    for word in words.lower().split():
        parts = [p for p in re.split(r"[-_]+", word) if p]
        if any(p in cues for p in parts) and all(p in CUES or p in BESIDE for p in parts):
            return True
    return False


def label_of(name: str, attrs: str) -> str:
    """The element's name and class words, digits as 0; with ! if it is furniture. Of main elements none is, of articles those that are comments or adverts."""
    if name in FURNITURE:
        return f"{name}!"
    if not attrs or attrs.isspace():
        return name
    named = ""
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "article" and key == "class" and _is_cue(value, NOT_MAIN):
            return f"{name}!"
        if name not in MAIN and (
            (key in ("class", "id") and _is_cue(value)) or (key == "role" and value.strip().lower() in ROLES) or key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true")
        ):
            return f"{name}!"
        if key == "class" and not named:
            named = "".join(f".{w}" for w in sorted(set(re.sub(r"\d+", "0", value).split())))
    return name + named


def _name(label: str) -> str:
    """The element's name alone, with its !; names of no known element are one."""
    if not label or label[0] in "#(":
        return label[:1]
    found = re.match(r"[^.!]*", label)[0]
    return (found if found in NAMES or found in FURNITURE or found in MAIN else "x") + ("!" if label.endswith("!") else "")


def parse(page: str, decode: bool = True) -> tuple[Node, list[str]]:
    """The page's folded tree and its texts. Without decode the texts are as they stand in the page."""
    root = Node("")
    stack: list[tuple[str, Node, bool]] = [("", root, False)]  # name, node, whether it is furniture or inside it
    hiding: list[str] = []  # the names of the open elements that are furniture
    opened: Counter[str] = Counter()
    texts: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        found = "".join(piece)
        piece.clear()
        _, node, hidden = stack[-1]
        if hidden or not found or found.isspace():
            return
        if decode:
            found = " ".join(htmllib.unescape(found).split())
            if not found:
                return
        node.kids.append(Node("#", None, xxhash.xxh64_intdigest(found.encode("utf-8", "surrogatepass")) - (1 << 63), len(found), [len(texts)]))
        texts.append(found)

    def pop() -> str:
        name, _, hidden = stack.pop()
        opened[name] -= 1
        if hidden and not stack[-1][2]:
            hiding.pop()
        return name

    at = seek = 0
    while (begin := page.find("<", seek)) >= 0:
        head = page[begin + 1 : begin + 2]
        if head in ("!", "?"):
            piece.append(page[at:begin])
            if page.startswith("<![CDATA[", begin):
                end = page.find("]]>", begin)
                piece.append(htmllib.escape(page[begin + 9 : end if end >= 0 else len(page)]))
                at = seek = end + 3 if end >= 0 else len(page)
                continue
            close = "-->" if page.startswith("<!--", begin) else ">"
            end = page.find(close, begin + (4 if close == "-->" else 2))
            at = seek = end + len(close) if end >= 0 else len(page)
            continue
        if not (head.isascii() and head.isalpha()) and not (head == "/" and page[begin + 2 : begin + 3].isascii() and page[begin + 2 : begin + 3].isalpha()):
            seek = begin + 1
            continue
        m = TAG.match(page, begin) or LOOSE_TAG.match(page, begin)
        piece.append(page[at:begin])
        if not m:  # a tag that the page's end cuts off is no text
            at = len(page)
            break
        at = seek = m.end()
        closes, name, attrs = bool(m[1]), m[2].lower(), m[3]
        if not closes and name in RAW_END:
            end = RAW_END[name].search(page, at)
            at = seek = end.end() if end else len(page)
            continue
        if name in ("html", "body"):
            if name == "body" and not closes:
                while opened["head"]:
                    pop()
                piece.clear()
            continue
        label = "" if closes else label_of(name, attrs)
        if name in INLINE and not (label.endswith("!") if not closes else opened[name]):
            continue  # only furniture within a line is a block of its own
        flush()
        if name in VOID:
            continue
        if closes:
            if opened[name]:
                while pop() != name:
                    pass
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD:
            pop()
        if name in ENDS_P and stack[-1][0] == "p":
            pop()
        if stack[-1][0] in SELF_CLOSING.get(name, ()):
            pop()
        if attrs.endswith("/") and (name in ("svg", "math") or name not in NAMES):
            continue
        _, parent, hidden = stack[-1]
        node = parent
        if hidden and (label == "main" or label.startswith("main.") or (name == "article" and not label.endswith("!") and hiding[-1] in HOLDS_ARTICLE)):
            hidden = False  # this element shows again; what stands around it doesn't
        if label.endswith("!") and not hidden:
            hiding.append(name)
        if not hidden and len(stack) <= MOST_DEPTH:
            node = Node(label)
            parent.kids.append(node)
        opened[name] += 1
        stack.append((name, node, hidden or label.endswith("!")))
    piece.append(page[at:])
    flush()
    return folded(root), texts


def pairs(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
    """A longest common subsequence of the labels."""
    a, b = 0, 0
    while a < min(len(x), len(y)) and x[a].label == y[a].label:
        a += 1
    while b < min(len(x), len(y)) - a and x[-1 - b].label == y[-1 - b].label:
        b += 1
    u, v = x[a : len(x) - b], y[a : len(y) - b]
    out = [(i, i) for i in range(a)]
    if u and v:
        best = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
        for i in range(len(u) - 1, -1, -1):
            for j in range(len(v) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if u[i].label == v[j].label else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(u) and j < len(v):
            if u[i].label == v[j].label:
                out.append((a + i, a + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(len(x) - b + i, len(y) - b + i) for i in range(b)]


def united(a: Node, b: Node, one_page: bool) -> Node:
    """What either of two nodes of one label matches, in place of the first. one_page: both stand on the same page, one after the other."""
    if one_page:
        a.low = a.high = xxhash.xxh64_intdigest(f"{a.low},{b.low}") - (1 << 63)
        a.repeated = True
    else:
        a.low, a.high, a.pages = min(a.low, b.low), max(a.high, b.high), a.pages + b.pages
        a.repeated |= b.repeated
        a.optional |= b.optional
    a.chars += b.chars
    a.blocks += b.blocks
    if a.any_order or b.any_order:
        a.kids = _by_name([*a.kids, *b.kids], one_page, {_name(k.label) for k in a.kids} & {_name(k.label) for k in b.kids})
        a.any_order = True
        return a
    kids, i, j = [], 0, 0
    for p, q in [*pairs(a.kids, b.kids), (len(a.kids), len(b.kids))]:
        for k in (*a.kids[i:p], *b.kids[j:q]):
            k.optional = True
            kids.append(k)
        if p < len(a.kids):
            kids.append(united(a.kids[p], b.kids[q], one_page))
        i, j = p + 1, q + 1
    a.kids = kids
    return folded(a, deep=False)


def _by_name(kids: list[Node], one_page: bool, sure: set[str] = frozenset()) -> list[Node]:
    """One node for all children of a name."""
    by: dict[str, Node] = {}
    for k in kids:
        name = _name(k.label)
        if name in by:
            united(by[name], k, one_page)
        else:
            k.label = by.setdefault(name, k) and name
    for name, k in by.items():
        k.repeated = True
        k.optional |= name not in sure
    return list(by.values())


def folded(node: Node, deep: bool = True) -> Node:
    """The node with neighbours of one label, and runs of two or three labels that follow themselves, as repetitions."""
    if node.any_order:
        return node
    out: list[Node] = []
    for kid in node.kids:
        if deep:
            folded(kid)
        if out and out[-1].label == kid.label:
            united(out[-1], kid, one_page=True)
            continue
        out.append(kid)
        for w in (2, 3):
            run = out[-w:]
            if len(out) > w and len(run) == w:
                group = f"({' '.join(k.label for k in run)})"
                if out[-w - 1].label == group:
                    del out[-w:]
                    united(out[-1], Node(group, run), one_page=True)
                    break
                if len(out) >= 2 * w and [k.label for k in out[-2 * w : -w]] == [k.label for k in run]:
                    first = Node(group, out[-2 * w : -w])
                    del out[-2 * w :]
                    out.append(united(first, Node(group, run), one_page=True))
                    break
    node.kids = out
    if len(out) > MOST_CHILDREN:
        node.kids, node.any_order = _by_name(out, one_page=True), True
    return node


def slots(node: Node) -> list[Node]:
    return [k for k in node.walk() if k.label == "#"]


def outermost(node: Node, name: str) -> list[Node]:
    """The elements of a name that aren't within another."""
    return [node] if _name(node.label) == name else [m for k in node.kids for m in outermost(k, name)]


def pattern(node: Node) -> str:
    """The wrapper as a union-free regular expression, for people: # is a slot, . a template text."""
    inner = "".join(map(pattern, node.kids))
    own = ("#" if node.low != node.high else ".") if node.label == "#" else inner if not node.label or node.label[0] == "(" else f"<{node.label}>{inner}</{re.match("[^.!]*", node.label)[0]}>"
    return f"({own})" + "+" * node.repeated + "?" * node.optional if node.optional or node.repeated else own


class Wrapper:
    """A host's wrapper with its main region and its template texts."""

    def __init__(self, root: Node):
        self.root = root
        every = slots(root)
        differs = any(s.low != s.high for s in every)
        weight = lambda node: sum(s.chars for s in slots(node) if not differs or s.low != s.high)
        self.main = [root]
        articles, mains = outermost(root, "article"), outermost(root, "main")
        of_all = lambda nodes: sum(map(weight, nodes))
        if articles and 2 * of_all(articles) >= of_all(mains):
            self.main = articles
        elif mains:
            self.main = mains
        else:
            all_of, at = weight(root), root
            while step := [k for k in at.kids if k.label != "#" and _name(k.label) != "p" and 2 * weight(k) > all_of]:
                at = step[0]
            self.main = [at]
        own = [s for node in self.main for s in slots(node)]
        same = [s for s in own if s.low == s.high and s.pages >= max(LEAST_PAGES, root.pages / 2)]
        total = sum(s.chars for s in own)
        self.template = {id(s) for s in same} if sum(s.chars for s in same) <= MOST_TEMPLATE * total else set()

    def extract(self, page: Node, texts: list[str]) -> str | None:
        """The text of the page's main region, or None if the page lacks it."""
        taken: list[int] = []

        def match(w: Node | None, p: Node, inside: bool) -> None:
            inside |= any(w is m for m in self.main)
            if p.label == "#":
                if inside and not (w is not None and id(w) in self.template):
                    taken.extend(p.blocks)
                return
            of: dict[int, Node] = {}
            if w is not None and (w.any_order or p.any_order):
                names = {_name(k.label): k for k in w.kids}
                of = {j: names[_name(k.label)] for j, k in enumerate(p.kids) if _name(k.label) in names}
            elif w is not None:
                of = {j: w.kids[i] for i, j in pairs(w.kids, p.kids)}
            for j, k in enumerate(p.kids):
                match(of.get(j), k, inside)

        match(self.root, page, False)
        return " ".join(texts[i] for i in sorted(taken)) if taken else None


def extract(page: str, wrapper: Wrapper | None) -> str:
    tree, texts = parse(page)
    found = wrapper.extract(tree, texts) if wrapper else None
    if found is None:
        found = Wrapper(tree).extract(tree, texts)
    return found or ""


def _fill(root: Node, found: list[tuple[int, int, int, int]], pages: int) -> Node:
    for node in root.walk():
        node.pages = pages
    for slot, (low, high, n, chars) in zip(slots(root), found, strict=True):
        slot.low, slot.high, slot.pages, slot.chars = int(low), int(high), int(n), int(chars)
    return root


def _facts(root: Node) -> list[tuple[int, int, int, int]]:
    return [(s.low, s.high, s.pages, s.chars) for s in slots(root)]


def _dumps(node: Node) -> str:
    return json.dumps(node.to_list(), separators=(",", ":"), ensure_ascii=False)


def _loads(wrapper: str) -> Wrapper:
    shape, pages, facts = json.loads(wrapper)
    return Wrapper(_fill(Node.of_list(shape), facts, pages))


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host and wrapper (JSON of its shape, distinct pages and slots) of every host with two distinct pages or more.

    Pages of equal shape and texts count once. Shapes of a host are aligned in the order of their text, FAN_IN at a
    time, until one wrapper remains, so the result doesn't depend on where the rows lie.
    """

    def make() -> Callable[[list], list[tuple]]:
        def shape(page: str | None) -> tuple:
            tree, _ = parse(page or "", decode=False)
            found = slots(tree)
            return _dumps(tree), [s.low for s in found], [s.chars for s in found]

        return lambda rows: [shape(h) for (h,) in rows]

    outputs = [("shape", StringType()), ("texts", ArrayType(LongType())), ("sizes", ArrayType(LongType()))]
    found = map_rows(pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("page")), ["page"], outputs, make)
    found = materialize(found.select("host", "shape", F.md5("shape").alias("of"), "texts", "sizes"), "page-shapes")
    once = found.groupBy("host", "of", "texts", "sizes").agg(F.count(F.lit(1)).alias("copies"))
    counts = once.groupBy("host", "of").agg(F.count(F.lit(1)).alias("pages"))
    places = once.select("host", "of", F.posexplode(F.arrays_zip("texts", "sizes")).alias("pos", "s"))
    facts = places.groupBy("host", "of", "pos").agg(F.min("s.texts").alias("low"), F.max("s.texts").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("s.sizes").alias("chars"))
    facts = facts.groupBy("host", "of").agg(F.sort_array(F.collect_list(F.struct("pos", "low", "high", "n", "chars"))).alias("slots"))
    shapes = found.groupBy("host", "of").agg(F.first("shape").alias("shape"))  # equal shapes are equal strings
    state = counts.join(shapes, ["host", "of"]).join(facts, ["host", "of"], "left")
    slot = F.transform(F.coalesce("slots", F.array().cast("array<struct<pos:int,low:bigint,high:bigint,n:bigint,chars:bigint>>")), lambda s: F.array(s["low"], s["high"], s["n"], s["chars"]))
    wrapper = F.concat(F.lit("["), "shape", F.lit(","), F.col("pages").cast("string"), F.lit(","), F.to_json(slot), F.lit("]"))
    state = materialize(state.select("host", wrapper.alias("wrapper"), "pages"), "shapes")

    def align(group: pd.DataFrame) -> pd.DataFrame:
        out, total = None, 0
        for w in sorted(group["wrapper"]):
            shape, n, facts = json.loads(w)
            node = _fill(Node.of_list(shape), facts, n)
            total += n
            out = node if out is None else united(out, node, one_page=False)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps([out.to_list(), total, _facts(out)], separators=(",", ":"), ensure_ascii=False)], "pages": [total]})

    while True:
        most = state.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return state.where("pages > 1").select("host", "wrapper")
        bucket = F.pmod(F.xxhash64("wrapper"), F.lit(max(1, -(-most // FAN_IN))))
        state = materialize(state.withColumn("bucket", bucket).groupBy("host", "bucket").applyInPandas(align, "host string, wrapper string, pages long"), "wrappers")


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", out: str = "text") -> DataFrame:
    """Appends the main text of each page and its code points (n_chars)."""
    (host,) = fresh(pages, "host")
    wrappers = materialize(infer_wrappers(pages, url_col, html_col), "host-wrappers")
    named = pages.withColumn(host, host_of(url_col))
    outputs = [(out, StringType()), ("n_chars", LongType())]
    if (wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= MOST_SENT:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})

        def make() -> Callable[[list], list[tuple]]:
            known: dict[str, Wrapper | None] = {}

            def one(page: str | None, of: str) -> tuple:
                if of not in known:
                    known[of] = _loads(sent.value[of]) if of in sent.value else None
                text = extract(page or "", known[of])
                return text, len(text)

            return lambda rows: [one(*r) for r in rows]

        return map_rows(named, [html_col, host], outputs, make).drop(host)
    # Each host's pages are dealt over salts by their size, for which its wrapper is repeated.
    salt, salts, its, its_salt = fresh(named, "salt", "salts", "its_host", "its_salt")
    sizes = named.groupBy(F.col(host).alias(its)).agg(F.ceil((F.sum(F.coalesce(F.length(html_col), F.lit(0)) + 1)) / MOST_GROUP).cast("int").alias(salts))
    sized = materialize(sizes.join(wrappers.withColumnRenamed("host", "of_host"), F.col(its) == F.col("of_host"), "left").select(its, salts, "wrapper"), "host-salts")
    # Most hosts have one salt and need no look-up; pages of the others meet few, small rows.
    large = sized.where(F.col(salts) > 1).select(its, salts)
    dealt = named.join(large, F.col(host) == F.col(its), "left").withColumn(salt, F.pmod(F.xxhash64(html_col, url_col), F.coalesce(salts, F.lit(1))).cast("int")).drop(its, salts)
    keep = [c for c in pages.columns if c.lower() not in (out.lower(), "n_chars")]
    schema = StructType([*[pages.schema[c] for c in keep], *[StructField(n, t) for n, t in outputs]])
    arrow = to_arrow_schema(schema)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        wrapper = next((_loads(w) for w in right["wrapper"].to_pylist() if w), None) if right.num_rows else None
        texts = [extract(h or "", wrapper) for h in left[html_col].to_pylist()]
        return pa.Table.from_arrays([*[left[c] for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names).cast(arrow)

    repeated = sized.select(its, F.explode(F.sequence(F.lit(0), F.col(salts) - 1)).alias(its_salt), "wrapper")
    return dealt.groupBy(host, salt).cogroup(repeated.groupBy(its, its_salt)).applyInArrow(join, schema)
