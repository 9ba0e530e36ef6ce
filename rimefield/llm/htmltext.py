"""Main text of web pages, with site templates removed.

A tolerant parser builds the element tree of a page (implied end tags, void and raw elements, unclosed tags). The
hash of an element covers its tag, its texts and its children's hashes. Subtrees are counted per host in the contexts
they stand in, a context being the hash of the parent's children in any order: what recurs only because the whole article around it recurs has one
context. A subtree in many contexts (3 or more, and a share of the host's distinct pages that falls from a tenth on
small hosts to a hundredth on large ones) is template and deleted, wherever it stands: outside the article any
element, inside it containers (div, section, lists, tables) with links or without prose. Prose, a subtree with a
paragraph of over 50 words, is template only outside of <article> and <main> and on half of the host's pages:
passages that articles share stay.

What recurrence can't show, on hosts of few pages or in blocks that differ from page to page, is left to tags, roles
and class or id tokens that name a menu, an advert and the like: the tags decide for any element, names for containers
only, never for headings, paragraphs or list items, and a name is the whole token or the token's beginning before a
part word ("share-buttons", not "share-prices"). If the page has an <article> or <main>, the text comes from there.

Blocks end at block elements; <br> counts as white space. White space is that of ASCII: character references to other
spaces are decoded and stay. Null and empty html give the empty text. Repeated rows count once, and each gives a row;
page_id may be null. Pages without a host form one host. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

LEAST_PAGES, LEAST_SHARE, LARGE_SHARE, PROSE_SHARE, PROSE_WORDS, SHORT_WORDS = 3, 0.1, 0.01, 0.5, 50, 30
#: Templates that may be sent to all tasks, in hashes; pages of a host in one task where they can't be sent.
MOST, PER_TASK = 2_000_000, 20_000
RAW = "script|style|noscript|template|svg|iframe|textarea|title|math|object|canvas|video|audio"
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|([^<]++)|<""", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
SPACE = re.compile(r"[\x20\x09-\x0D]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Tags whose start ends an open element of the set (and what holds them).
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("html body table ul ol dl article section div main aside nav header footer form select".split())
NO_TEXT = frozenset("head nav aside footer form button select input label fieldset dialog menu map datalist optgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices newsletter subscribe subscription signup share sharing social related recommended popup modal overlay widget widgets masthead pagination pager toolbar login search skip".split())
#: What may follow a name in a token.
PARTS = frozenset("area bar block bottom box button buttons col column container content form group holder icons inner item items left link links list main menu nav outer panel posts right row section slot side tab thread top unit widget wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section ul ol dl details figure table span center".split())
PROSE = frozenset("p blockquote pre".split())
LINKS = frozenset("a button input form".split())


class Node:
    __slots__ = ("tag", "attrs", "parts", "up", "digest", "context")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.attrs, self.up, self.parts, self.digest, self.context = tag, attrs, up, [], 0, 0

    def any(self, tags: frozenset) -> bool:
        todo = [self]
        while todo:
            n = todo.pop()
            if n.tag in tags:
                return True
            todo += [x for x in n.parts if isinstance(x, Node)]
        return False


def parse(source: str) -> Node:
    root = at = Node("#root", "", None)
    for m in TOKEN.finditer(source):
        raw, close, tag, attrs, text = m.groups()
        if text is not None:
            at.parts.append(text)
        elif raw is not None or tag is None:
            if m[0] == "<":
                at.parts.append("<")
        elif close:
            tag = tag.lower()
            n = at
            while n.up and n.tag != tag:
                if tag not in BLOCKS and n.tag in BLOCKS:  # an inline end tag ends nothing beyond its block
                    n = root
                    break
                n = n.up
            if n.up:
                at = n.up
            elif tag == "br":
                at.parts.append(" ")
        else:
            tag = tag.lower()
            if tag == "br":
                at.parts.append(" ")
                continue
            ends = IMPLIED.get(tag, set()) | ({"p"} if tag in BLOCKS else set()) | (HEADINGS if tag in HEADINGS else set())
            n = at
            while ends and n.up and n.tag not in SCOPE:
                if n.tag in ends:
                    at = n.up
                n = n.up
            new = Node(tag, attrs, at)
            at.parts.append(new)
            if tag not in VOID:
                at = new
    return root


def post_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [x for x in n.parts if isinstance(x, Node)]
    return out[::-1]


def hash_tree(root: Node) -> None:
    for n in post_order(root):
        parts = [n.tag]
        for x in n.parts:
            if isinstance(x, Node):
                parts.append(f"<{x.digest:x}>")
            elif t := SPACE.sub(" ", x).strip():
                parts.append(t)
        n.digest = _hash(parts)
        n.context = _hash(sorted(parts))


def _hash(parts: list[str]) -> int:
    d = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "replace"))
    return d - (1 << 64) if d >> 63 else d


def telling(token: str) -> bool:
    """Whether a class or id is a name, alone or with part words and numbers."""
    first, *rest = re.split(r"[-_]+", token.strip("-_"))
    return first in NAMES and all(r in PARTS or r in NAMES or r.isdigit() for r in rest)


def unwanted(n: Node, in_main: bool) -> bool:
    if n.tag in NO_TEXT:
        return True
    if n.tag == "header" and not (in_main and n.any(HEADINGS)):
        return True
    if n.attrs and n.tag not in ("html", "body", "article", "main", "#root"):
        for m in ATTRIBUTE.finditer(n.attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                return True
            if name == "role" and value in ROLES:
                return True
            if name in ("class", "id") and n.tag in CONTAINERS and any(map(telling, value.split())):
                return True
    return False


def landmarks(root: Node) -> list[Node]:
    """The outermost articles that aren't comments or asides, else <main>, else nothing."""
    def find(tags):
        out, todo = [], [root]
        while todo:
            n = todo.pop()
            if n is not root and unwanted(n, False):
                continue
            if n.tag in tags:
                out.append(n)
            else:
                todo += [x for x in reversed(n.parts) if isinstance(x, Node)]
        return out

    found = find({"article"}) or find({"main"})
    return found


def words_of(n: Node) -> int:
    todo, out = [n], 0
    while todo:
        for x in todo.pop().parts:
            if isinstance(x, Node):
                todo.append(x)
            else:
                out += len(x.split())
    return out


def holds_prose(n: Node, of_words: int = PROSE_WORDS) -> bool:
    todo = [n]
    while todo:
        x = todo.pop()
        if x.tag in PROSE and words_of(x) > of_words:
            return True
        todo += [y for y in x.parts if isinstance(y, Node)]
    return False


def key(n: Node) -> int:
    """The hash under which a subtree is counted: prose has its own."""
    return n.digest ^ 0x5DEECE66D if holds_prose(n) else n.digest


def candidates(root: Node) -> list[Node]:
    """The page's elements that may be template; no element that holds the article."""
    marks = landmarks(root)
    holders, out = set(), []
    for m in marks:
        n = m
        while n:
            holders.add(id(n))
            n = n.up
    todo = [(root, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or any(n is m for m in marks)
        for x in n.parts:
            if isinstance(x, Node):
                todo.append((x, inside))
        if id(n) in holders or n.tag in ("#root", "html", "head", "body") or not n.parts:
            continue
        if not inside or n.tag in CONTAINERS and not holds_prose(n) and (n.any(LINKS) or not n.any(PROSE) and words_of(n) <= SHORT_WORDS):
            out.append(n)
    return out


def main_text(root: Node, template: frozenset | set = frozenset()) -> str:
    marks = landmarks(root)
    blocks: list[str] = []
    line: list[str] = []

    def end():
        t = SPACE.sub(" ", entities.unescape("".join(line))).strip(" ")
        if t:
            blocks.append(t)
        line.clear()

    guard = {id(n) for n in candidates(root) if key(n) in template} if template else frozenset()
    for top in marks or [root]:
        todo: list = [(top, 0)]
        end()
        while todo:
            n, i = todo.pop()
            if i == 0:
                if n is not top and (unwanted(n, bool(marks)) or id(n) in guard):
                    continue
                if n.tag in BLOCKS:
                    end()
            while i < len(n.parts):
                x = n.parts[i]
                i += 1
                if isinstance(x, Node):
                    todo += [(n, i), (x, 0)]
                    break
                line.append(x)
            else:
                if n.tag in BLOCKS:
                    end()
        end()
    return "\n".join(blocks)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, hash, prose, context): the page itself as hash 0 in the context of its own hash."""
    for b in batches:
        hosts, hashes, prose, contexts = [], [], [], []
        for host, source in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
            root = parse(source.as_py() or "")
            hash_tree(root)
            got = {(0, False, root.digest)}
            for n in candidates(root):
                k = key(n)
                got.add((k, k != n.digest, n.up.context))
            for k, p, c in got:
                hosts.append(host)
                hashes.append(k)
                prose.append(p)
                contexts.append(c)
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(prose, pa.bool_()), pa.array(contexts, pa.int64())], ["host", "hash", "prose", "context"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for source, template in zip(b.column("html"), b.column("template"), strict=True):
            root = parse(source.as_py() or "")
            known = set(template.as_py() or ())
            if known:
                hash_tree(root)
            texts.append(main_text(root, known))
        yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def templates(pages: DataFrame, least: int = LEAST_PAGES, share: float = LEAST_SHARE, large: float = LARGE_SHARE, prose: float = PROSE_SHARE) -> DataFrame:
    """(host, pages, template): for each host with templates its distinct pages and the hashes of its template subtrees. A hash needs the
    share of the host's pages, so a host has at most 1 / large times as many as a page has subtrees."""
    p = pages.select(host_of(F.col("url")).alias("host"), "html")
    found = p.mapInArrow(_subtrees, "host string, hash long, prose boolean, context long").distinct()
    counts = materialize(found.groupBy("host", "hash", "prose").agg(F.count("*").alias("n")).where((F.col("n") >= least) | (F.col("hash") == 0)))
    hosts = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    # A tenth up to 1,000 pages, then a hundredth of what is beyond.
    need = F.when(F.col("prose"), F.col("pages") * prose).otherwise(F.least(F.col("pages"), F.lit(1000)) * share + F.greatest(F.col("pages") - 1000, F.lit(0)) * large)
    return counts.where("hash <> 0").join(hosts, "host").where(F.col("n") >= need).groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list("hash").alias("template"))


def extract(pages: DataFrame, most: int = MOST, per_task: int = PER_TASK, **options) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host_of(F.col("url")))
    known = materialize(templates(pages, **options))
    if (known.agg(F.sum(F.size("template"))).first()[0] or 0) <= most:
        p = p.join(F.broadcast(known.select("host", "template")), "host", "left")
    else:
        # Hosts of many pages are dealt to several tasks; there are at most pages / per_task of them.
        dealt = known.select("host", "template", F.ceil(F.col("pages") / per_task).cast("int").alias("parts"))
        hot = dealt.where("parts > 1").select("host", "parts")
        p = p.join(F.broadcast(hot), "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "html"), F.coalesce("parts", F.lit(1))).cast("int"))
        p = p.join(dealt.select("host", "template", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["host", "part"], "left")
    return p.select("page_id", "url", "html", "template").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
