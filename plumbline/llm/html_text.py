"""Main text of web pages by site template removal.

Every element subtree of a page is hashed (name, markup and words of all that it holds). Spark counts, for
each host, on how many different pages a hash stands. Subtrees outside a page's article that recur on a share of
its host's different pages are template and go, unless nothing would be left of the page's text, as do elements whose name, role or class says that they are a menu, header,
footer, sidebar, notice, advert, form or comment. Inside an article the share is larger, as sites quote and repeat
passages, and those are text; running text, list items and table cells go only with the block that holds them.
What is left of the page's article is its text. A class or id never removes html, body or what holds the article.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, stash, table
from plumbline.llm.url_rules import host_and_path

#: A subtree is template if it stands on at least this many different pages of its host, and on this share of them.
RECURS, SHARE = 3, 0.2
#: The same inside an article.
INSIDE_RECURS, INSIDE_SHARE = 5, 0.5

#: Elements without content, elements of running text, and those whose content is never text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg canvas".split())
DROPPED = frozenset("nav header footer aside form button select dialog menu fieldset head".split()) | RAW
#: An open element that ends when one of these begins inside it.
CLOSES = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
#: Where such an element may not be closed past.
SCOPE = frozenset("ul ol dl table td th body html article section div main".split())
#: Words that mark what is not the article, in a role, or in a class or id that has no words but these and NEUTRAL ones.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside complementary contentinfo "
    "cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login share sharing social related comment comments disqus reply replies respond form search widget widgets toolbar pagination skip masthead".split()
)
#: Words that only tell where or how a container stands.
NEUTRAL = frozenset("area bar block bottom box button buttons bg container content fixed global group holder inner item items left link links list listing main outer page panel post primary region right row secondary section site sticky strip thread top unit wrap wrapper zone".split())
#: Elements whose class or id can mark them: others are text, whatever their names are.
CONTAINERS = frozenset("div section ul ol dl table tbody details figure center".split())
#: Marks that stay marks when the heading below says the same.
READERS = frozenset("comment comments disqus reply replies respond".split())
ARTICLE = frozenset(["article", "main"])
#: Elements that are no template by themselves inside an article.
PARTS = INLINE | frozenset("li dt dd td th tr tbody thead tfoot caption br".split())

#: A tag ends at the first `>` outside quotes, or, if a quote stays open or another tag begins before it, at the first `>`. No part can be read in two ways, so the search is linear.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/><]*+)(?:((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)>)", re.S)
#: An attribute's name and value; values are read whole, so that words in them are no names.
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"\d+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("attrs", "digest", "items", "name")

    def __init__(self, name: str, attrs: str):
        self.name, self.attrs = name, attrs
        self.items: list[Node | str] = []
        self.digest = 0


def parse(page: str) -> Node:
    """A page's element tree. Stray ends are dropped; open elements end with what holds them."""
    root = Node("#root", "")
    stack, at, n, last = [root], 0, len(page), page.rfind(">")
    block = [0]  # for each open element the place of the nearest one that is not inline
    opened: Counter[str] = Counter()

    def cut(x: int) -> None:
        opened.subtract(y.name for y in stack[x:])
        del stack[x:], block[x:]

    endless: set[str] = set()  # names of which no end stands further on
    while at < n:
        m = _TAG.search(page, at) if at <= last else None
        if m is None:  # no tag ends after the last `>`, but a comment may begin
            stack[-1].items.append(page[at : page.find("<!--", at) if page.find("<!--", at) >= 0 else n])
            break
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            for x in range(len(stack) - 1 if opened[name] > 0 else 0, 0, -1):
                if stack[x].name == name:
                    cut(x)
                    break
                if name in INLINE and stack[x].name not in INLINE:  # an inline end does not close a block
                    break
            continue
        while len(stack) > 1:
            # an element that the new one ends, looked for up to the nearest holder
            x = block[-1]
            if x > 0 and name in CLOSES.get(stack[x].name, ()):
                cut(x)
                continue
            if stack[-1].name not in SCOPE and x > 0 and stack[x].name not in SCOPE and name in ("li", "dt", "dd", "tr", "td", "th"):
                y = next((y for y in range(x, 0, -1) if stack[y].name in CLOSES and name in CLOSES[stack[y].name]), 0)
                if y and not any(s.name in ("ul", "ol", "dl", "table") for s in stack[y:]):
                    cut(y)
                    continue
            break
        attrs = m[3] if m[3] is not None else m[4] or ""
        closed = attrs.endswith("/")
        node = Node(name, attrs.removesuffix("/"))
        stack[-1].items.append(node)
        if name in RAW:
            end = None if name in endless else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if end is None:
                endless.add(name)
            if name in ("script", "style", "textarea", "title", "iframe", "noscript"):
                node.items.append(page[at : end.start() if end else n])
                at = end.end() if end else n
                continue
        if name not in VOID and not closed:
            block.append(block[-1] if name in INLINE else len(stack))
            stack.append(node)
            opened[name] += 1
    return root


def _words(token: str) -> list[str] | None:
    """The words of a class or id if all of them are known ones; words that run together are taken apart."""
    out: list[str] = []
    for run in _WORD.findall(token):
        if len(run) > 40:
            return None
        ways: list[list[str] | None] = [[], *[None] * len(run)]
        for end in range(1, len(run) + 1):
            for begin in range(end):
                word = run[begin:end]
                if ways[begin] is not None and (word in MARKS or word in NEUTRAL) and (ways[end] is None or len(ways[begin]) < len(ways[end]) - 1):
                    ways[end] = [*ways[begin], word]
        if ways[-1] is None:
            return None
        out += ways[-1]
    return out


def _marks(value: str) -> frozenset[str]:
    """The marks in a class, id or role: of each of its names that has no other words than marks and neutral ones."""
    known = _MARKS.get(value)
    if known is None:
        if len(_MARKS) > 50_000:
            _MARKS.clear()
        known = _MARKS[value] = frozenset(w for token in value.split() for w in _words(token) or () if w in MARKS)
    return known


#: Marks of classes and ids that a task has seen: sites repeat theirs on every page.
_MARKS: dict[str, frozenset[str]] = {}


def attributes(node: Node) -> list[tuple[str, str]]:
    """Names and values, lower-case."""
    return [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _ATTR.finditer(node.attrs)] if node.attrs else []


def hidden(node: Node) -> bool:
    """Whether name, role or a hidden attribute says that this is no part of an article."""
    if node.name in DROPPED:
        return True
    if node.name in ("html", "body"):
        return False
    return any(kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "role" and bool(_marks(value))) for kind, value in attributes(node))


def classed(node: Node) -> bool:
    """Whether a class or id says so: only of a container that is no article. An id that repeats the words of the element's own heading is an anchor, unless it is one of readers' comments."""
    if node.name not in CONTAINERS:
        return False
    for kind, value in attributes(node):
        found = _marks(value) if kind in ("class", "id") else frozenset()
        if found and (kind == "class" or found & READERS or _NUMBER.sub("", value) != heading_id(node)):
            return True
    return False


def heading_id(node: Node) -> str:
    """The id that is made of the words of the heading that an element begins with; empty without one."""
    first = next((x for x in node.items if isinstance(x, Node) or x.strip()), None)
    if not isinstance(first, Node) or first.name not in HEADINGS:
        return ""
    return "-".join(_WORD.findall(" ".join(y for x in _walk(first) for y in x.items if isinstance(y, str)).lower()))


def marked(node: Node) -> bool:
    """Whether name or markup says that this is no part of an article."""
    return hidden(node) or classed(node)


def _walk(node: Node) -> Iterator[Node]:
    """All elements, children before parents; without recursion, as pages may nest deeply."""
    todo, out = [node], []
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [y for y in x.items if isinstance(y, Node)]
    return reversed(out)


def digest(root: Node) -> None:
    """Give each element its subtree's hash."""
    for x in _walk(root):
        h = xxhash.xxh64(f"{x.name} {' '.join(x.attrs.split())}")
        for y in x.items:
            h.update(y.digest.to_bytes(8, "little") if isinstance(y, Node) else " ".join(y.split()).encode())
            h.update(b"\0")
        x.digest = h.intdigest()


def articles(root: Node) -> list[Node]:
    """The page's articles: its outermost article elements, else main elements, that stand under the fewest marked elements; none without such an element.

    Classes and ids do not rule one out, but an article under a marked element, as a comment or a teaser is, gives way to others.
    """
    found: list[tuple[bool, int, Node]] = []
    todo = [(root, "", 0)]
    while todo:
        x, inside, marks = todo.pop()
        if x is not root and hidden(x):
            continue
        marks += classed(x)
        role = next((v for k, v in attributes(x) if k == "role"), "")
        kind = x.name if x.name in ARTICLE else role if role in ARTICLE else ""
        if kind and inside != "article" and kind != inside:
            found.append((kind == "article", -marks, x))
        todo += [(y, "article" if "article" in (inside, kind) else inside or kind, marks) for y in reversed(x.items) if isinstance(y, Node)]
    best = max((f[:2] for f in found), default=(False, 0))
    first = [x for *rank, x in found if tuple(rank) == best]
    if best[1] < 0:  # all are under marked elements: the one with the most text
        return [max(first, key=lambda x: sum(len(y) for z in _walk(x) for y in z.items if isinstance(y, str)))]
    return first


def subtrees(page: str | None) -> tuple[list[int], list[int], bool]:
    """Distinct hashes (signed) of the elements that may be template: outside the article, inside it; and whether there is one."""
    root = parse(page or "")
    digest(root)
    cores = articles(root)
    tops = {id(x) for x in cores}
    out: set[int] = set()
    within: set[int] = set()
    todo = [(root, False)]
    while todo:
        x, inside = todo.pop()
        if id(x) in tops:
            inside = True
        elif inside:
            if x.name not in PARTS:
                within.add(x.digest)
        elif x is not root and x.name not in ("html", "body"):
            out.add(x.digest)
        todo += [(y, inside) for y in x.items if isinstance(y, Node)]
    signed = lambda found: [x - (1 << 64) if x >> 63 else x for x in found]
    return signed(out), signed(within), bool(cores)


def main_text(page: str | None, template: set[int]) -> str:
    """What is left without template and marked elements, within the articles if the page has any. Blocks are joined by one space.

    Of a header inside an article its headings stay. A page of which nothing would be left keeps its template; if it is still empty, what only classes and ids mark.
    """
    root = parse(page or "")
    digest(root)
    cores = articles(root)
    return _left(root, cores, template, marked) or (_left(root, cores, set(), marked) if template else "") or _left(root, cores, set(), hidden)


def _left(root: Node, cores: list[Node], template: set[int], gone: Callable[[Node], bool]) -> str:
    parts: list[str] = []
    tops = {id(x) for x in cores or [root]}
    todo: list[Node | str] = list(reversed(cores or [root]))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if id(x) not in tops:
            signed = x.digest - (1 << 64) if x.digest >> 63 else x.digest
            if cores and x.name == "header":
                todo += [y for y in _walk(x) if y.name in HEADINGS][::-1]
                continue
            if gone(x) or (signed in template and (not cores or x.name not in PARTS)):
                parts.append(" " if x.name not in INLINE else "")
                continue
        if x.name not in INLINE:
            parts.append(" ")
            todo.append(" ")
        todo += reversed(x.items)
    return " ".join(entities.unescape("".join(parts)).split())


def extract(pages: DataFrame, recurs: int = RECURS, share: float = SHARE) -> DataFrame:
    """Each page's main text: page_id, url, text, n_chars (code points).

    pages: page_id, url, html. A null html is empty and gives the empty text; a null url has an empty host,
    which is a host like others. Repeated pages stay, but equal html counts once on a host: a subtree is template
    there if it stands on at least recurs different pages and on that share of them; inside an article,
    INSIDE_RECURS and INSIDE_SHARE hold, for the pages where it stands inside one. Character references are
    decoded, white space becomes one space. A host's pages never meet in one task: hashes are counted by
    (host, hash) with partial sums. A host has few template hashes, at most what 1 / share pages hold, or
    recurs / share on small hosts; they meet the pages' hashes, not the pages. No rows: no result; columns other
    than the three are not read, whatever their names; parsing takes time and memory in proportion to a page.
    """
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    rows = rows.withColumn("page", F.xxhash64("host", "html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [subtrees(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _, _ in found], pa.list_(pa.int64())), pa.array([x for _, x, _ in found], pa.list_(pa.int64())), pa.array([x for *_, x in found], pa.bool_())], names=["host", "page", "hashes", "within", "article"])

    each = stash(rows.select("host", "page", "html").mapInArrow(hashes, "host string, page long, hashes array<long>, within array<long>, article boolean"))
    different = stash(each.dropDuplicates(["page"]))
    discard(each)
    sizes = different.groupBy("host").agg(F.count("*").alias("pages"))

    def recurring(name: str, least: int, part: float) -> DataFrame:
        """host, template: hashes of that list that stand on so many different pages of the host, and on that share of them."""
        often = different.select("host", F.explode(name).alias("hash")).groupBy("host", "hash").count().where(F.col("count") >= least)
        return stash(often.join(sizes, "host").where(F.col("count") / F.col("pages") >= part).groupBy("host").agg(F.collect_list("hash").alias("template")))

    def asked(pages: DataFrame, name: str, template: DataFrame) -> DataFrame:
        return pages.join(template, "host").select("page", F.array_intersect(name, "template").alias("template")).where("size(template) > 0")

    # what stands outside an article is not kept anyway: a page with one looks up what stands inside
    bare = asked(different.where("not article"), "hashes", recurring("hashes", recurs, share))
    mine = stash(bare.unionByName(asked(different.where("article"), "within", recurring("within", INSIDE_RECURS, INSIDE_SHARE))))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(x.as_py(), set(y.as_py() or ())) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(mine, "page", "left").select("page_id", "url", "html", "template").mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
