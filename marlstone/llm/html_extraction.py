"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its elements, told apart by their path of block elements (with first class or id). A host may have
several layouts: pages whose outer elements are the same are a group, and what is left over in groups of fewer than
`LAYOUT_PAGES` is one more. Over the pages of a group each token has an occurrence vector: how often it comes on each
page. Tokens with equal vectors form an equivalence class. A class is valid if it comes on most pages or has several tokens, and these are nested in one
another or in valid classes; the valid classes, nested, are the group's template, and what lies in its elements are
slots. Slots whose text never changes are the template's own. The article is the slot with most changing text outside
links; what elements are called (`article`, `main`, names of menus, adverts and so on) only weighs that evidence by a
factor. All text of the article is kept, also what pages of a host share, but for elements that are menus, footers,
forms and the like by their kind, or by a class that other pages have too and that says nothing else. Elements whose
class only holds such a word (`related-work`), noscript and headers outside an article element go if the template
confirms it: if all in them is the same on every page or is mostly links. A header right below the body goes always.

A page is parsed once: its paths and blocks of text are stored. Vectors are never gathered: a host's token keeps a
sum of hashes of (page, count), equal for equal vectors, so a host with a third of all pages is a few sums from each
task. Only tokens on at least 1 / `SUPPORT` of a group's pages are gathered, at most SUPPORT times the mean number of a
page's tokens; no html or text is shuffled to meet its template while the articles are few enough to broadcast.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import as_text, chunks, small, spread, stored

_RAW = "script|style|template|textarea|iframe|title|select|svg|object"
_MARKUP = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*["']?([^"'>]*)""", re.IGNORECASE)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OWN_CLOSE = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
_APART = frozenset("head nav footer aside form button dialog menu label fieldset".split())
_APART_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Words that may stand beside those above in the name of an element that is nothing else.
_PLAIN_WORDS = frozenset("area articles bar block box button buttons container content footer form header inner items item links link list main module outer panel post posts row section stories text title top bottom left right wrap wrapper".split())
_MAIN = frozenset(("article", "main"))
#: Elements that the outer ones of a layout are told apart by, and how deep; pages that a group of one layout has at least.
_OUTER, LAYOUT_DEPTH, LAYOUT_PAGES = frozenset("html body div main article section table header center".split()), 4, 4
#: A token counts for a template if it is on at least 1 / SUPPORT of the group's pages, and two; what an element's name
#: weighs for or against its being the article's.
SUPPORT, FOR, AGAINST = 64, 4.0, 1 / 16
#: Hosts and layouts whose articles are broadcast at most; beyond, pages and articles are shuffled by them.
BROADCAST_HOSTS = 100_000


@dataclass
class Page:
    """A page's paths in the order of their first elements: label, number of the path above, name for all pages,
    occurrences, letters, linked letters, digest of the text, and the last three with what lies below; and its blocks of
    text as (number of path, text).

    A label ends in ! if its kind of element stands apart from articles, in ? if its class or id says so, in ~ if
    that holds a word that may say so."""

    labels: list[str] = field(default_factory=lambda: [""])
    above: list[int] = field(default_factory=lambda: [0])
    ids: list[int] = field(default_factory=lambda: [0])
    counts: list[int] = field(default_factory=lambda: [1])
    letters: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    digests: list[int] = field(default_factory=lambda: [0])
    under_letters: list[int] = field(default_factory=list)
    under_linked: list[int] = field(default_factory=list)
    under_digests: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    _known: dict[tuple[int, str], int] = field(default_factory=dict)

    def enter(self, above: int, label: str) -> int:
        at = self._known.get((above, label))
        if at is None:
            at = self._known[above, label] = len(self.labels)
            self.labels.append(label)
            self.above.append(above)
            self.ids.append(xxhash.xxh64_intdigest(label, self.ids[above] % 2**64) - 2**63)
            for column in (self.counts, self.letters, self.linked, self.digests):
                column.append(0)
        self.counts[at] += 1
        return at

    def add(self, at: int, text: str, linked: int) -> None:
        self.letters[at] += len(text)
        self.linked[at] += linked
        self.digests[at] = crc32(text.encode("utf-8", "replace"), self.digests[at])
        self.blocks.append((at, text))

    def sum_up(self) -> None:
        """Fills what each path has together with the paths below it, which come after it."""
        self.under_letters, self.under_linked, self.under_digests = ([*x] for x in (self.letters, self.linked, self.digests))
        for k in range(len(self.labels) - 1, 0, -1):
            up = self.above[k]
            self.under_letters[up] += self.under_letters[k]
            self.under_linked[up] += self.under_linked[k]
            if self.under_letters[k]:
                self.under_digests[up] = crc32(self.under_digests[k].to_bytes(4, "big"), self.under_digests[up])

    def layout(self) -> int:
        """A hash of the page's outer elements; what may stand apart is none of them, as it comes and goes."""
        depth, outer = [0] * len(self.labels), []
        for k in range(1, len(self.labels)):
            depth[k] = depth[self.above[k]] + 1 if depth[self.above[k]] >= 0 and _kind(self.labels[k]) in _OUTER and self.labels[k][-1] not in "!?~" else -1
            if 0 < depth[k] <= LAYOUT_DEPTH:
                outer.append(self.ids[k])
        return xxhash.xxh64_intdigest(",".join(map(str, sorted(outer)))) - 2**63


def _label(name: str, attributes: str) -> str:
    named = {k.lower(): v.lower() for k, v in _NAMED.findall(attributes)} if attributes else {}
    if named.get("role") == "main":
        name = "main"
    words = [w for k in ("class", "id") for w in named.get(k, "").split()]
    label = name + (("." + re.sub(r"\d+", "0", words[0])) if words else "")
    if name in _APART:
        return label + "!"
    named = [set(re.split(r"[-_\d]+", w)) - {""} for w in words]
    if any(_APART_WORDS & w and w <= _APART_WORDS | _PLAIN_WORDS for w in named):
        return label + "?"
    return label + "~" if name == "noscript" or any(_APART_WORDS & w for w in named) else label


def parse(page: str) -> Page:
    out = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    parts: list[str] = []
    links, linked, at = False, 0, 0

    def close_block() -> None:
        nonlocal parts, linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.add(stack[-1][1], text, linked)
            parts, linked = [], 0

    def text_between(start: int, stop: int) -> None:
        nonlocal linked
        if start < stop:
            parts.append(page[start:stop])
            linked += (stop - start) * links

    for m in _MARKUP.finditer(page):
        text_between(at, m.start())
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"] and m["raw"].lower() != "svg":
                close_block()
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                links = not m["end"]
            continue
        close_block()
        if m["end"]:
            if any(s[0] == name for s in stack[1:]):
                while stack.pop()[0] != name:
                    pass
            continue
        if stack[-1][0] == "p" or name in _OWN_CLOSE and stack[-1][0] in (name, _OWN_CLOSE[name]):
            stack.pop()
        entered = out.enter(stack[-1][1], _label(name, m["attributes"]))
        if name not in _VOID and not m["attributes"].endswith("/"):
            stack.append((name, entered))
    text_between(at, len(page))
    close_block()
    out.sum_up()
    return out


def _kind(label: str) -> str:
    return label.partition(".")[0].rstrip("!?~")


class Host:
    """What is deduced of a host's pages of one layout. tokens: id, above (id), label, vector, pages, most (times on one
    page), letters, linked, constant; under_letters, under_linked and under_constant with what lies below; `pages`: of the
    group."""

    def __init__(self, pages: int, tokens: list[dict]):
        self.pages, self.tokens = pages, {t["id"]: t for t in tokens if t["id"]}
        self._depth = {0: 0}
        self.template = self._template()

    def depth(self, token: int) -> int:
        """Of a token whose tokens above are all known, else below all others."""
        chain = []
        while token not in self._depth and token in self.tokens:
            chain.append(token)
            token = self.tokens[token]["above"]
        depth = self._depth.get(token, 10**9)
        for t in reversed(chain):
            depth = self._depth[t] = depth + 1
        return depth

    def _template(self) -> set[int]:
        """The tokens of the valid classes, and 0, the page."""
        classes: dict[object, list[dict]] = defaultdict(list)
        for t in self.tokens.values():
            classes[t["vector"]].append(t)
        valid = {0}
        for members in sorted(classes.values(), key=lambda c: (-c[0]["pages"], min(self.depth(t["id"]) for t in c))):
            if members[0]["pages"] * 2 > self.pages or len(members) > 1:
                for t in sorted(members, key=lambda t: self.depth(t["id"])):
                    if t["above"] in valid:
                        valid.add(t["id"])
        return valid

    def _apart(self, label: str) -> bool:
        return label[-1:] in ("!", "?")

    def article(self) -> int:
        """The token whose slot is the article; 0 for the whole page. If no slot has text that changes (the pages
        are copies, say), all text counts."""
        return self._article(True) or self._article(False)

    def _article(self, changing: bool) -> int:
        slots: dict[int, float] = defaultdict(float)
        for t in self.tokens.values():
            if t["letters"] and not (changing and t["constant"] and t["pages"] > 2):
                # Up to the template's nearest element around this one, which has the slot.
                at, apart = t["above"], self._apart(t["label"])
                while at not in self.template and at in self.tokens:
                    apart |= self._apart(self.tokens[at]["label"])
                    at = self.tokens[at]["above"]
                if at in self.template:
                    slots[at] += (t["letters"] - 2 * t["linked"]) * (AGAINST if apart else 1)

        def weighed(slot: int) -> float:
            factor = FOR if slot and _kind(self.tokens[slot]["label"]) in _MAIN else 1.0
            at = slot
            while at:
                factor *= AGAINST if self._apart(self.tokens[at]["label"]) else 1
                at = self.tokens[at]["above"]
            return slots[slot] * factor

        best = max(slots, key=lambda s: (weighed(s), -self.depth(s), s), default=0)
        if not best or weighed(best) <= 0:
            return 0
        at = best
        while at:  # the rest of an article element around the slot belongs to it
            if _kind(self.tokens[at]["label"]) in _MAIN and self.tokens[at]["most"] == 1:
                return at
            at = self.tokens[at]["above"]
        return best

    def _confirmed(self, t: dict) -> bool:
        """Whether all in the element is the same on all its pages, of two or more, or mostly links."""
        return t["under_letters"] > 0 and (t["under_constant"] and t["pages"] > 1 or 2 * t["under_linked"] >= t["under_letters"])

    def _of_an_article(self, token: int) -> bool:
        while token in self.tokens:
            token = self.tokens[token]["above"]
            if token in self.tokens and _kind(self.tokens[token]["label"]) in _MAIN:
                return True
        return False

    def apart(self) -> list[int]:
        """Tokens that don't belong to an article they lie in: those that stand apart by their class and that other
        pages have too (or there is no other page); those whose class may say so, and headers, if that is confirmed."""
        out = []
        for t in self.tokens.values():
            if t["label"].endswith("?"):
                gone = t["pages"] > 1 or self.pages < 2
            elif t["label"].endswith("~"):
                gone = self._confirmed(t)
            elif _kind(t["label"]) == "header" and not self._of_an_article(t["id"]):
                above = self.tokens.get(t["above"])
                gone = above is None or _kind(above["label"]) in ("html", "body") or self._confirmed(t)
            else:
                continue
            if gone:
                out.append(t["id"])
        return sorted(out)


def main_text(page: Page, article: int | None, apart: list[int] | None) -> str:
    """The blocks below `article` in page order, with two line feeds between; if the page has no such element, below
    the article deduced from the page alone."""
    if article is None or article not in page.ids:
        tokens = [{"id": i, "above": page.ids[a], "label": label, "vector": n, "pages": 1, "most": n, "letters": letters, "linked": linked, "constant": False, "under_letters": under, "under_linked": under_linked, "under_constant": False} for i, a, label, n, letters, linked, under, under_linked in zip(page.ids, page.above, page.labels, page.counts, page.letters, page.linked, page.under_letters, page.under_linked, strict=True)]
        alone = Host(1, tokens)
        article, apart = alone.article(), alone.apart()
    dropped, inside = set(apart or ()), [False] * len(page.ids)
    for k, (i, above, label) in enumerate(zip(page.ids, page.above, page.labels, strict=True)):
        inside[k] = i == article or k > 0 and inside[above] and not label.endswith("!") and i not in dropped
    return "\n\n".join(text for at, text in page.blocks if inside[at])


def extract_text(page: str) -> str:
    """The main text of a page by itself."""
    return main_text(parse(page), None, None)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


_PATHS = {"labels": pa.string(), "above": pa.int32(), "ids": pa.int64(), "counts": pa.int32(), "letters": pa.int64(), "linked": pa.int64(), "digests": pa.int64(), "under_letters": pa.int64(), "under_linked": pa.int64(), "under_digests": pa.int64()}
_PARSED = "layout long, labels array<string>, above array<int>, ids array<long>, counts array<int>, letters array<long>, linked array<long>, digests array<long>, under_letters array<long>, under_linked array<long>, under_digests array<long>, block_at array<int>, block_text array<string>"


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, page: a hash, layout, and the fields of `Page`) of pages (page_id, url, html), stored."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "html"):
            found = [parse(x) for x in as_text(chunk.column("html"))]
            kept = [*(chunk.column(c) for c in ("page_id", "url", "host", "page")), pa.array([p.layout() for p in found], pa.int64())]
            lists = [pa.array([getattr(p, c) for p in found], pa.list_(t)) for c, t in _PATHS.items()]
            blocks = [pa.array([[b[k] for b in p.blocks] for p in found], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *lists, *blocks], names=["page_id", "url", "host", "page", "layout", *_PATHS, "block_at", "block_text"])

    source = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("page"), "html")
    return stored(spread(source).mapInArrow(read, f"page_id {kind}, url string, host string, page long, {_PARSED}"))


def with_groups(parsed: DataFrame, least: int = LAYOUT_PAGES) -> DataFrame:
    """`parsed_pages` with `layout` 0 for pages whose layout has fewer than `least` pages of the host."""
    groups = stored(parsed.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("host", "layout", F.lit(True).alias("own")))
    return parsed.join(small(groups, BROADCAST_HOSTS), ["host", "layout"], "left").withColumn("layout", F.when(F.col("own"), F.col("layout")).otherwise(F.lit(0).cast("long"))).drop("own")


def host_templates(grouped: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(host, layout, article, apart: array of ids, template: array of ids) of every host and layout in `with_groups`."""
    tokens = grouped.select("host", "layout", "page", F.explode(F.arrays_zip("ids", F.transform("above", lambda k: F.element_at("ids", k + 1)).alias("over"), *(c for c in _PATHS if c not in ("ids", "above")))).alias("t"))
    same = lambda c: F.min(c) == F.max(c)
    summed = stored(
        tokens.groupBy("host", "layout", F.col("t.ids").alias("id"))
        .agg(
            F.min("t.over").alias("above"),
            F.min("t.labels").alias("label"),
            F.sum(F.xxhash64("page", "t.counts").cast("decimal(38,0)")).cast("string").alias("vector"),
            F.count(F.lit(1)).alias("pages"),
            F.max("t.counts").alias("most"),
            F.sum("t.letters").alias("letters"),
            F.sum("t.linked").alias("linked"),
            same("t.digests").alias("constant"),
            F.sum("t.under_letters").alias("under_letters"),
            F.sum("t.under_linked").alias("under_linked"),
            same("t.under_digests").alias("under_constant"),
        )
    )
    totals = summed.where("id = 0").select("host", "layout", F.col("pages").alias("total"))
    enough = (F.col("pages") * support >= F.col("total")) & ((F.col("pages") > 1) | (F.col("total") < 3))
    frequent = summed.join(small(totals, BROADCAST_HOSTS), ["host", "layout"]).where(enough)
    held = F.struct("id", "above", "label", "vector", "pages", "most", "letters", "linked", "constant", "under_letters", "under_linked", "under_constant")
    gathered = frequent.groupBy("host", "layout").agg(F.max("total").alias("total"), F.collect_list(held).alias("tokens"))

    def deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = [Host(n, tokens) for n, tokens in zip(batch.column("total").to_pylist(), batch.column("tokens").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array([h.article() for h in hosts], pa.int64()), pa.array([h.apart() for h in hosts], pa.list_(pa.int64())), pa.array([sorted(h.template) for h in hosts], pa.list_(pa.int64()))], names=["host", "layout", "article", "apart", "template"])

    return gathered.select("host", "layout", "total", "tokens").mapInArrow(deduce, "host string, layout long, article long, apart array<long>, template array<long>")


def extract_pages(pages: DataFrame, support: int = SUPPORT, layout_pages: int = LAYOUT_PAGES) -> DataFrame:
    """A row for each page (page_id, url, html): page_id, url, text, n_chars.

    A null html or one without an article gives an empty text; a null url belongs to the host ""; repeated rows have
    a row each; markup that is cut off at the end is dropped; an empty table gives no rows; other columns aren't read.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = with_groups(parsed_pages(pages.select("page_id", "url", "html")), layout_pages)
    articles = stored(host_templates(parsed, support).select("host", "layout", "article", "apart"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                texts = []
                for row in zip(*(rows.column(c).to_pylist() for c in (*_PATHS, "block_at", "block_text", "article", "apart")), strict=True):
                    page = Page(*row[: len(_PATHS)], blocks=[*zip(*row[len(_PATHS) : -2], strict=True)])
                    texts.append(main_text(page, *row[-2:]))
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = parsed.join(small(articles, BROADCAST_HOSTS), ["host", "layout"], "left")
    return joined.select("page_id", "url", *_PATHS, "block_at", "block_text", "article", "apart").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
