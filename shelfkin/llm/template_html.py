"""Main text of web pages by templates deduced from pages of the same host.

A token is the role of an element (the path of block elements to it) or a whole text
block in its role.  Its occurrence vector says how often it occurs on each different page
of the host; vectors are never built, their fingerprints are added up page by page.

1. Tokens with equal vectors form an equivalence class.  Classes on too few pages are no
   template; a member whose place among the roles of a page may change relative to its
   neighbour in the class is not ordered and leaves the class.
2. Classes are nested: a class lies in the class that its members' nearest enclosing
   template role belongs to.
3. Text tokens of a valid class are template: a block that occurs wherever a role of the
   page skeleton occurs, or on nearly all pages, belongs to the skeleton.
4. What is left between template tokens are slots.  The main slot is the deepest role
   that occurs once per page and holds most of the varying words.  Its text is extracted
   without the template's text tokens.

Menus, footers, sidebars, notices, adverts, forms and comments inside or beside the slot
are left out; they are known by their elements or by the words of their classes and ids.
An element known by words or a form that holds most of the words is a wrapper, and stays.
Every host is treated by the same rule; one with fewer than LEAST_PAGES different pages has
no evidence of a template, so its pages are read by their own article, main or body.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfkin.session import materialize

from .common import append_columns, held, pieces, texts

LEAST_PAGES = 3
SUPPORT = 0.5
CONSTANT = 0.9
MAIN_SHARE = 0.6
WRAPPER_SHARE = 0.5  # an element that holds so much of the text is no advert or comment
VARYING_SHARE = 0.2  # a slot that varies less is a text in copies, not a template
DEEPEST = 200  # elements nested deeper have the role of the element that deep
TEMPLATE_ROWS = 20_000  # sites whose templates are broadcast, a few hundred bytes each; more are joined

TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-z][^>]*>|([^<]+|<)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER_TEXT = set("nav footer aside form menu dialog button head input object audio video canvas map".split())
NEVER_NAMED = set(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising banner promo sponsor sponsored "
    "notice notices cookie cookies consent gdpr popup modal newsletter subscribe signup login search comment comments respond reply replies disqus share social contentinfo complementary".split()
)
HEADERS = {"header", "masthead", "topbar"}
CONTENT = {"article", "main"}


class Page:
    """Blocks (path, text) and the paths of all block elements of a page, in page order."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str]] = []
        self.elements: list[str] = []
        self.stack: list[tuple[str, str]] = []
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        for raw, slash, tag, attributes, text in TOKENS.findall(source):
            if text:
                self.text.append(text)
            elif tag:
                self._tag(tag.lower(), bool(slash), attributes)
            elif raw.lower() in ("textarea", "select", "title", "iframe", "svg"):
                self._flush()
        self._flush()

    def _path(self) -> str:
        return self.stack[-1][1] if self.stack else ""

    def _flush(self) -> None:
        if self.text:
            joined = " ".join(html.unescape("".join(self.text)).split())
            self.text = []
            if joined:
                self.blocks.append((self._path(), joined))

    def _tag(self, tag: str, end: bool, attributes: str) -> None:
        if tag in INLINE:
            return
        self._flush()
        if tag in VOID:
            return
        if end:
            if self.open[tag]:
                while self._pop() != tag:
                    pass
            return
        if tag in ENDS_PARAGRAPH and any(t == "p" for t, _ in self.stack[-3:]):
            while self._pop() != "p":
                pass
        elif tag in ENDS_SAME:
            lowest = max(-1, len(self.stack) - DEEPEST)
            depth = next((k for k in range(len(self.stack) - 1, lowest, -1) if self.stack[k][0] in ENDS_SAME[tag] or self.stack[k][0] in ("ul", "ol", "dl", "table", "select")), -1)
            if depth >= 0 and self.stack[depth][0] in ENDS_SAME[tag]:
                # A row ends the cells and the row before it.
                while depth > 0 and self.stack[depth - 1][0] in ENDS_SAME[tag]:
                    depth -= 1
                while len(self.stack) > depth:
                    self._pop()
        if len(self.stack) < DEEPEST:
            path = f"{self._path()}/{self._label(tag, attributes)}"
            self.elements.append(path)
        else:
            path = self._path()
        self.stack.append((tag, path))
        self.open[tag] += 1

    def _pop(self) -> str:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        return tag

    @staticmethod
    def _label(tag: str, attributes: str) -> str:
        """Element name with its class, id and role, marked ! never main text, ~ hardly so by its words, ? a header."""
        named = " ".join(a or b or c for a, b, c in NAMED.findall(attributes)) if attributes else ""
        words = {w.lower() for w in WORD_PARTS.findall(named)}
        mark = ""
        if tag not in CONTENT and tag not in ("html", "body"):
            if tag in NEVER_TEXT:
                mark = "!"
            elif tag == "form" or words & NEVER_NAMED:
                mark = "~"
            elif tag in HEADERS or words & HEADERS:
                mark = "?"
        return mark + tag + ("." + re.sub(r"[\d/]+", "0", " ".join(named.split())) if named else "")


def _is_main(path: str) -> bool:
    return bool(re.search(r"/(?:article|main)(?:\.[^/]*)?$|\.(?:[^/]* )?main$", path))


def _within(path: str, top: str) -> bool:
    return path == top or path.startswith(top + "/")


def _prefixes(path: str, sign: str, base: int = 0) -> list[str]:
    """The marked elements on a path, below its first ``base`` characters."""
    out, at = [], path.find(f"/{sign}", base)
    while at >= 0:
        end = path.find("/", at + 1)
        out.append(path if end < 0 else path[:end])
        at = path.find(f"/{sign}", at + 1)
    return out


def left_out(words: dict[str, int], base: int = 0) -> set[str]:
    """Elements marked by their words that hold too little of the text to be wrappers of it.

    ``words`` are the words of every role; roles in elements that never are main text do not count.
    """
    counted = {p: n for p, n in words.items() if p.find("/!", base) < 0}
    held: Counter[str] = Counter()
    for path, n in counted.items():
        for marked in _prefixes(path, "~", base):
            held[marked] += n
    whole = sum(counted.values())
    return {e for e, n in held.items() if n < WRAPPER_SHARE * whole}


def _cleared(words: dict[str, int], base: int = 0) -> set[str]:
    """The roles that are neither marked ! nor inside an element left out."""
    away = left_out(words, base)
    return {p for p in words if p.find("/!", base) < 0 and not any(e in away for e in _prefixes(p, "~", base))}


def extract(page: Page, container: str | None, template: set[int]) -> str:
    """The text of the main slot; without a template of the site, of the page's own article, main or body."""
    words: dict[str, int] = {}
    for path, text in page.blocks:
        words[path] = words.get(path, 0) + len(text.split())
    top = container if container and container in set(page.elements) else _own_container(page, words)
    base = len(top or "")
    inside = {p: n for p, n in words.items() if top is None or _within(p, top)}
    headings = {e for path in page.elements if re.search(r"/h[1-6](?:\.[^/]*)?$", path) for e in _prefixes(path, "?", base)}
    roles = {p for p in _cleared(inside, base) if not _loose_header(p, base, headings)}
    blocks = [(p, t) for p, t in page.blocks if p in roles]
    kept = [t for p, t in blocks if _hash(f"{p}\0{t}") not in template] if template else [t for _, t in blocks]
    # A page without words of its own keeps those it shares.
    return " ".join(kept or [t for _, t in blocks])


def _loose_header(path: str, base: int, headings: set[str]) -> bool:
    """Whether a block lies in a header that is not the heading of the main slot."""
    headers = _prefixes(path, "?", base)
    return bool(headers) and (base == 0 or headers[0] not in headings)


def _own_container(page: Page, words: dict[str, int]) -> str | None:
    """The article or main element with most words; those inside marked elements only if there is no other."""
    candidates = {e for e in page.elements if _is_main(e)}
    if not candidates:
        return None
    held: Counter[str] = Counter()
    for path, n in words.items():
        at = path.find("/", 1)
        while at >= 0:
            if path[:at] in candidates:
                held[path[:at]] += n
            at = path.find("/", at + 1)
        if path in candidates:
            held[path] += n
    plain = {e for e in candidates if "/!" not in e and "/~" not in e and held[e]} or {e for e in candidates if held[e]} or candidates
    return max(sorted(plain, key=lambda c: (-len(c), c)), key=lambda c: (held[c], "article" in c.rsplit("/", 1)[-1]))


TOKEN_SCHEMA = "site string, token bigint, path string, is_text boolean, vector bigint, times bigint, words bigint, place int"


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per page and distinct token."""
    for batch in batches:
        for part in pieces(batch, 4 << 20):
            out: list[tuple] = []
            for site, source in zip(texts(part, "site"), texts(part, "html"), strict=True):
                page = Page(source)
                seen = xxhash.xxh3_64_intdigest(source.encode())
                words = Counter()
                for path, text in page.blocks:
                    words[path] += len(text.split())
                # The place counts roles that are on the page for the first time.
                for place, (path, n) in enumerate(Counter(page.elements).items()):
                    out.append((site, _hash(path), path, False, _vector(seen, n), n, words[path], place))
                for (path, text), n in Counter(page.blocks).items():
                    out.append((site, _hash(f"{path}\0{text}"), path, True, _vector(seen, n), n, n * len(text.split()), 0))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in TOKEN_SCHEMA.split(", ")])


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def _vector(page: int, times: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{page} {times}".encode()) - (1 << 63)


def _sum_of_halves() -> F.Column:
    """The sum of 64-bit numbers as text, half by half, so that no sum leaves its range."""
    low, high = F.sum(F.col("vector").bitwiseAND(F.lit((1 << 32) - 1))), F.sum(F.shiftrightunsigned("vector", 32))
    return F.concat_ws(":", low, high)


def without_copies(pages: DataFrame) -> DataFrame:
    """One page of every group of equal sources on a site, the first by url and id."""
    same = F.xxhash64("html")
    groups = pages.groupBy("site", same.alias("source")).agg(F.min(F.struct("url", "id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = held(groups.select(F.col("site").alias("of"), "source", "first"))
    joined = pages.withColumn("same", same).join(groups, (F.col("site") == F.col("of")) & (F.col("same") == F.col("source")), "left")
    return joined.where(F.col("first").isNull() | F.struct("url", "id").eqNullSafe(F.col("first"))).drop("of", "source", "first", "same")


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """(site, token, path, is_text, vector, pages, times, words, low, high): tokens on half of a site's pages or more.

    ``vector`` is the fingerprint of the occurrence vector: tokens of a site with equal
    ``vector`` and ``pages`` are one class.  ``pages`` are different pages, without copies.
    """
    tokens = without_copies(pages).mapInArrow(_tokens, TOKEN_SCHEMA)
    summed = tokens.groupBy("site", "token", "is_text").agg(
        F.first("path").alias("path"), _sum_of_halves().alias("vector"), F.count("*").alias("pages"),
        F.sum("times").alias("times"), F.sum("words").alias("words"), F.min("place").alias("low"), F.max("place").alias("high"),
    )
    # Tokens of one page only are the bulk and can be part of no template.
    summed = materialize(summed.where("pages > 1"), "page-tokens")
    size = summed.where("not is_text").groupBy("site").agg(F.max("pages").alias("all"))
    return summed.join(size, "site").where(F.col("pages") >= F.greatest(F.lit(2), SUPPORT * F.col("all")))


def template_of(tokens: pd.DataFrame) -> tuple[list[tuple[str, int, int]], str | None, list[int]]:
    """Nested classes [(path, class, enclosing class)], the role of the main slot, and its template text tokens."""
    total = int(tokens["all"].iloc[0])
    roles = tokens[~tokens["is_text"]].sort_values(["low", "path"])
    of: dict[str, int] = {}
    valid: set[tuple[str, int]] = set()
    for number, (vector, members) in enumerate(roles.groupby(["vector", "pages"], sort=False)):
        last = -1
        for path, low, high in zip(members["path"], members["low"], members["high"], strict=True):
            if low > last:
                of[path] = number
                last = high
                valid.add(vector)

    def enclosing(path: str) -> int:
        while path := path.rpartition("/")[0]:
            if path in of:
                return of[path]
        return -1

    nested = [(p, c, enclosing(p)) for p, c in of.items()]
    if total < LEAST_PAGES:
        return nested, None, []
    # A text token is template in the class of a role, or on nearly all pages.
    texts_ = tokens[tokens["is_text"]]
    shared = [(v, n) in valid or n >= CONSTANT * total for v, n in zip(texts_["vector"], texts_["pages"], strict=True)]
    fixed = texts_[np.array(shared, bool)]
    words = dict(zip(roles["path"], roles["words"].astype(int), strict=True))
    varying = dict(words)
    for path, n in zip(fixed["path"], fixed["words"].astype(int), strict=True):
        if path in varying:
            varying[path] = max(0, varying[path] - n)
    plain = {p: varying[p] for p in _cleared(varying) if "/?" not in p}
    all_words = sum(plain.values())
    once = [p for p, n, k in zip(roles["path"], roles["times"], roles["pages"], strict=True) if n == k and k >= CONSTANT * total and p in of and p in plain]
    held_by: Counter[str] = Counter()
    wanted = set(once)
    for path, n in plain.items():
        at = path.find("/", 1)
        while at >= 0:
            if path[:at] in wanted:
                held_by[path[:at]] += n
            at = path.find("/", at + 1)
        if path in wanted:
            held_by[path] += n
    named = [p for p in once if _is_main(p) and held_by[p] > 0]
    full = named or [p for p in once if all_words and held_by[p] >= MAIN_SHARE * all_words and not re.search(r"/(?:p|h[1-6]|li|td|blockquote)(?:\.[^/]*)?$", p)]
    container = max(full, key=lambda p: (held_by[p] if named else 0, p.count("/"), p)) if full else None
    inside = fixed[np.array([container is None or _within(p, container) for p in fixed["path"]], bool)]
    slot = sum(n for p, n in words.items() if container is None or _within(p, container))
    if slot and sum(inside["words"].astype(int)) > (1 - VARYING_SHARE) * slot:
        return nested, container, []
    return nested, container, sorted(inside["token"].astype(int).tolist())


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(site, container, fixed, template) of sites that share a template; a row per site.

    ``fixed`` are the tokens of text blocks that are template within the main slot.
    """

    def one(key, tokens: pd.DataFrame) -> pd.DataFrame:
        nested, container, fixed = template_of(tokens)
        rows = [{"path": p, "class": c, "within": w} for p, c, w in nested]
        return pd.DataFrame({"site": [key[0]], "container": [container], "fixed": [fixed], "template": [rows]})

    schema = "site string, container string, fixed array<bigint>, template array<struct<path:string,class:int,within:int>>"
    return equivalence_classes(pages).groupBy("site").applyInPandas(one, schema)


def with_site(pages: DataFrame, url: str = "url") -> DataFrame:
    """Append ``site``: the host in lower case, empty without one."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.withColumn("site", host)


def extract_pages(pages: DataFrame, page: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page, url, text, n_chars) of every row, with the main text of the whole source.

    A null or empty source gives an empty text; pages with a null url or one without a host
    share the host without a name.  Repeated rows and copies each give a row; copies are
    no evidence of a template.  Very long pages take time in proportion to their length.
    Other columns are not read.
    """
    rows = pages.select(F.col(f"`{page}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("html"))
    placed = with_site(rows)
    templates = materialize(deduce_templates(placed).select("site", "container", "fixed"), "page-templates")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        container = batch.column(batch.schema.get_field_index("container")).to_pylist()
        fixed = batch.column(batch.schema.get_field_index("fixed")).to_pylist()
        found = [extract(Page(s), c, set(k or [])) for s, c, k in zip(texts(batch, "html"), container, fixed, strict=True)]
        return [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]

    joined = placed.join(held(templates, TEMPLATE_ROWS), "site", "left")
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return append_columns(joined, fields, run).select(F.col("id").alias(page), F.col("url").alias(url), "text", "n_chars")
