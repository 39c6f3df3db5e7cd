"""Main text of web pages by template deduction from equivalence classes.

Pages of one host come from one template. A token is the start or the end of a
block element in its role (the chain of open elements around it); its occurrence
vector is how often it stands on each page of the host. Tokens with equal vectors
form an equivalence class. A class that is large and frequent is a candidate; it
is valid if its tokens keep one order on the pages and its runs nest with those
of the other classes. Valid classes, nested, are the host's template; the gaps
between their tokens are its slots, and a text is told by the slot it stands in:

* a text that stands in its role on most pages of the host is template itself;
* a slot whose text is mostly links, over all pages of the host, is a menu;
* where a page marks no article, slots that hold little beside the largest one
  are notices, headings apart.

What HTML itself says is kept to: scripts, forms, navigation and the like, and
elements that name themselves so, hold no main text; a marked article does.

Vectors of a host with any number of pages are compared by sums of hashed (page,
count), so classes come from one aggregation that is combined before the shuffle,
over all pages. A host's template is one row, bounded by the size of its pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A class has so many tokens, stands on this share of a host's pages and keeps order and nesting on this share of those.
LARGE, SUPPORT, VALID = 2, 0.5, 0.9
#: Slots and texts are judged where a host has so many pages: a template text stands on this share of them, a menu has
#: this share of its text in links, a notice this share of the largest slot's text a page.
PAGES, TEXT_SUPPORT, LINKS, SLIGHT = 5, 0.8, 0.5, 0.1
_PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math".split())
_HIDDEN = frozenset("head script style noscript template iframe svg math nav header footer aside form button select textarea input label dialog menu title object canvas".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_ENDS_P = _BLOCK - frozenset("body head html title td th tr tbody thead tfoot caption".split())
_SCOPED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Names that sites give to what is not the article; compared with the words of class, id and role.
_ASIDE_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_MAIN_NAMES = frozenset("main".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MASK = (1 << 64) - 1


class Node:
    """A piece of a page: a block element's start or end ("tag", with its token)
    or a text (with the role of the block it stands in)."""

    __slots__ = ("kind", "token", "aside", "main", "heading", "block", "text", "linked")

    def __init__(self, kind: str, token: int, aside: bool = False, main: bool = False, heading: bool = False, block: int = 0, text: str = "", linked: int = 0) -> None:
        self.kind, self.token, self.aside, self.main, self.heading, self.block, self.text, self.linked = kind, token, aside, main, heading, block, text, linked


class Open:
    """An open element."""

    __slots__ = ("name", "role", "aside", "main", "heading", "link", "block_role")

    def __init__(self, name: str, role: int, aside: bool, main: bool, heading: bool, link: bool, block_role: int) -> None:
        self.name, self.role, self.aside, self.main, self.heading, self.link, self.block_role = name, role, aside, main, heading, link, block_role


def parsed(page: str | None) -> list[Node]:
    """Tags and texts in page order. Never fails: unknown, stray and missing ends
    are made good as browsers do for the elements that matter here."""
    out: list[Node] = []
    stack = [Open("", 1, False, False, False, False, 1)]
    block, at, page = 0, 0, page or ""

    def text(piece: str) -> None:
        if piece:
            e = stack[-1]
            body = entities.unescape(piece)
            out.append(Node("text", e.block_role, e.aside, e.main, e.heading, block, body, len(body.strip()) if e.link else 0))

    def close(upto: int) -> None:
        nonlocal block
        while len(stack) > upto:
            e = stack.pop()
            if e.name in _BLOCK:
                block += 1
                out.append(Node("tag", (e.role * 31 + 17) & _MASK))

    n = len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        found = _PIECE.match(page, start)
        if not found:  # a lone "<" is text
            nxt = page.find("<", start + 1)
            text(page[at : nxt if nxt >= 0 else n])
            at = nxt if nxt >= 0 else n
            continue
        text(page[at:start])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if k and not (name in {"p", "b", "i", "a", "span", "em", "strong"} and any(e.name in {"td", "th", "table", "article", "main", "section", "div", "body"} for e in stack[k + 1 :])):
                close(k)
            elif name in {"p", "br"}:
                block += name == "p"
            continue
        if name in _ENDS_P:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name in {"p", "table", "td", "th", "button"}), 0)
            if k and stack[k].name == "p":
                close(k)
        if name in _SCOPED:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in _SCOPE[name]:
                    break
                if stack[k].name in _SCOPED[name]:
                    close(k)
                    break
        up = stack[-1]
        marks = " ".join(v.strip("\"'") for _, v in _ATTRIBUTE.findall(found[3] or ""))
        own = {w.lower() for w in _NAME.findall(marks)}
        role = xxhash.xxh64_intdigest(f"{name}|{marks}", up.role & 0xFFFFFFFF)
        inside = up.main or name in {"article", "main"} or bool(own & _MAIN_NAMES)
        # A header inside the article titles it; one of the page does not.
        hidden = up.aside or (name in _HIDDEN and not (name == "header" and up.main)) or bool(own & _ASIDE_NAMES and name not in {"body", "html"} and not (own & {"header"} and up.main and not own & (_ASIDE_NAMES - {"header"})))
        if name in _BLOCK:
            block += 1
            out.append(Node("tag", role))
        if name == "br":
            text(" ")
        if name in _VOID or (found[3] or "").endswith("/") and name in {"svg", "math"}:
            continue
        stack.append(Open(name, role, hidden, inside, up.heading or name in _HEADINGS, up.link or name == "a", role if name in _BLOCK else up.block_role))
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
            stop = end.start() if end else n
            if name == "title":
                text(page[at:stop])
            at = end.end() if end else n
            close(len(stack) - 1)
    close(1)
    return out


def _clean(text: str) -> str:
    return " ".join(text.split())


def pieces(page: str | None) -> list[Node]:
    """Tags and what blocks say, in page order: the texts of a block are one, what
    is aside and what is white space are left out."""
    out: list[Node] = []
    for node in parsed(page):
        if node.kind == "text":
            if node.aside:
                continue
            if out and out[-1].kind == "text" and out[-1].block == node.block:
                out[-1].text += node.text
                out[-1].linked += node.linked
                continue
        out.append(node)
    done = []
    for node in out:
        if node.kind == "text":
            node.text = _clean(node.text)
            if not node.text:
                continue
            node.token = xxhash.xxh64_intdigest(node.text, node.token & 0xFFFFFFFF)
        node.token -= (node.token >> 63) << 64
        done.append(node)
    return done


class Template:
    """Valid classes of a host, strongest first, its template texts, and the
    slots that are menus or notices. A slot is (class, tokens of it passed)."""

    def __init__(self, classes: list[list[int]] = (), texts: list[int] = (), menus: list[int] = (), notices: list[int] = ()) -> None:
        self.sizes = [len(c) for c in classes]
        self.of = {t: (c, j) for c, tokens in enumerate(classes) for j, t in enumerate(tokens)}
        self.texts, self.menus, self.notices = set(texts), set(menus), set(notices)

    def walk(self, tokens: list[int]) -> tuple[list[int], set[int]]:
        """(slot of each token, classes that break order or nesting). A class is
        a run of its tokens in their order, opened by the first and closed by the
        last; where two runs cross, the weaker class is at fault."""
        stack: list[list[int]] = []  # class, tokens passed
        bad: set[int] = set()
        slots = []
        for t in tokens:
            slots.append(stack[-1][0] << 16 | stack[-1][1] if stack else -1)
            c, j = self.of.get(t, (-1, 0))
            if c < 0 or c in bad:
                continue
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), -1)
            above = {x for x, _ in stack[at + 1 :]} if at >= 0 else set()
            if (j == 0) != (at < 0) or at >= 0 and stack[at][1] != j or any(x < c for x in above):
                bad.add(c)
                if at >= 0:
                    del stack[at]
            elif j == 0:
                stack.append([c, 1])
            else:
                bad |= above
                stack[at][1] += 1
                del stack[at + (stack[at][1] < self.sizes[c]) :]
        bad.update(c for c, _ in stack)
        return slots, bad


def _batched(found: dict[tuple, list[int]], names: list[str]) -> pa.RecordBatch:
    """(host, number...) -> counts, as one batch."""
    rows = [(*key, *n) for key, n in found.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if not k else pa.int64()) for k in range(len(names))], names)


def sketches(pages: DataFrame) -> DataFrame:
    """host, key, tokens array<long>, mass array<int>: each page's tokens in
    order; mass is 0 for a tag, the characters of a text, negative if most of
    them are links. pages(host, key, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces(p) for p in batch.column("html").to_pylist()]
            tokens = pa.array([[x.token for x in f] for f in found], pa.list_(pa.int64()))
            mass = pa.array([[(-1 if 2 * x.linked > len(x.text) else 1) * len(x.text) for x in f] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), tokens, mass], ["host", "key", "tokens", "mass"])

    return pages.select("host", "key", "html").mapInArrow(run, "host string, key long, tokens array<long>, mass array<int>")


def classes(drawn: DataFrame) -> DataFrame:
    """host, pages, classes array<array<long>> (strongest first, tokens in order),
    texts array<long>: candidate classes and template texts of sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[] for _ in range(6)]
            for host, key, tokens, mass in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "tokens", "mass"))):
                seen: dict[int, list[int]] = {}
                for at, t in enumerate(tokens):
                    seen.setdefault(t, [0, at])[0] += 1
                for part, new in zip(parts, ([host] * len(seen), [key] * len(seen), seen, [n for n, _ in seen.values()], [at for _, at in seen.values()], [mass[at] == 0 for _, at in seen.values()])):
                    part.extend(new)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(p, kind) for p, kind in zip(parts, kinds)], ["host", "key", "token", "n", "first", "tag"])

    counted = drawn.mapInArrow(run, "host string, key long, token long, n long, first long, tag boolean").withColumn("h", F.xxhash64("key", "n"))
    # Two halves of a hash, so that sums over any number of pages stay in range.
    vector = [F.sum(F.shiftrightunsigned("h", 32)).alias("v1"), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("v2")]
    each = counted.groupBy("host", "token", "tag").agg(F.count("*").alias("on_pages"), F.sum("n").alias("total"), F.sum("first").alias("first"), *vector)
    hosts = drawn.groupBy("host").agg(F.count("*").alias("pages"))
    often = F.col("on_pages") >= F.when(F.col("tag"), SUPPORT).otherwise(TEXT_SUPPORT) * F.col("pages")
    frequent = each.join(hosts, "host").where(often & (F.col("tag") | (F.col("pages") >= PAGES)))
    # Frequent tokens alone are gathered: a host has at most 1/SUPPORT times as many as a page.
    tags = frequent.where("tag").groupBy("host", "on_pages", "total", "v1", "v2").agg(F.array_sort(F.collect_list(F.struct("first", "token"))).alias("t")).where(F.size("t") >= LARGE)
    strong = F.struct((-F.col("on_pages")).alias("a"), (-F.size("t")).alias("b"), F.col("total").alias("c"), F.transform("t", lambda x: x["token"]).alias("tokens"))
    ranked = tags.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(strong)), lambda x: x["tokens"]).alias("classes"))
    texts = frequent.where("not tag").groupBy("host").agg(F.array_sort(F.collect_list("token")).alias("texts"))
    return hosts.join(ranked, "host", "left").join(texts, "host", "left")


def templates(pages: DataFrame) -> DataFrame:
    """host, classes array<array<long>>, texts, menus, notices array<long>: the
    template of each host. pages(host, key, html)."""
    spark = pages.sparkSession
    drawn = common.written(sketches(pages), "page-sketches")
    found = common.written(classes(drawn), "page-classes")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: dict[str, Template] = {}
            sums: dict[tuple, list[int]] = {}
            for host, tokens, own in zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), batch.column("classes")):
                template = kept.get(host) or kept.setdefault(host, Template(own.as_py() or []))
                _, bad = template.walk(tokens)
                for c in {template.of[t][0] for t in tokens if t in template.of}:
                    n = sums.setdefault((host, c), [0, 0])
                    n[0] += 1
                    n[1] += c not in bad
            yield _batched(sums, ["host", "class", "seen", "held"])

    each = drawn.select("host", "tokens").join(found.select("host", "classes"), "host").mapInArrow(checked, "host string, class long, seen long, held long")
    valid = each.groupBy("host", "class").agg(F.sum("seen").alias("seen"), F.sum("held").alias("held")).where(F.col("held") >= VALID * F.col("seen"))
    valid = valid.groupBy("host").agg(F.array_sort(F.collect_list("class")).alias("valid"))
    held = F.transform(F.coalesce("valid", F.array().cast("array<long>")), lambda c: F.get("classes", c.cast("int")))
    known = common.written(found.join(valid, "host", "left").select("host", "pages", held.alias("classes"), F.coalesce("texts", F.array().cast("array<long>")).alias("texts")), "page-valid")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: dict[str, Template] = {}
            sums: dict[tuple, list[int]] = {}
            for host, tokens, mass, own, texts in zip(*(batch.column(c).to_pylist() for c in ("host", "tokens", "mass")), batch.column("classes"), batch.column("texts")):
                template = kept.get(host) or kept.setdefault(host, Template(own.as_py(), texts.as_py()))
                slots, _ = template.walk(tokens)
                on = set()
                for t, m, slot in zip(tokens, mass, slots):
                    if m and t not in template.texts:
                        n = sums.setdefault((host, slot), [0, 0, 0])
                        n[0] += max(m, 0)
                        n[1] += max(-m, 0)
                        n[2] += slot not in on
                        on.add(slot)
            yield _batched(sums, ["host", "slot", "own", "linked", "on_pages"])

    # Only hosts with enough pages are measured.
    asked = drawn.join(known.where(F.col("pages") >= PAGES).select("host", "classes", "texts"), "host")
    slots = asked.select("host", "tokens", "mass", "classes", "texts").mapInArrow(measured, "host string, slot long, own long, linked long, on_pages long")
    slots = slots.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("own", "linked", "on_pages")]).withColumn("each", F.col("own") / F.col("on_pages"))
    most = slots.groupBy("host").agg(F.max("each").alias("most"))
    menu, notice = F.col("linked") > LINKS * (F.col("own") + F.col("linked")), F.col("each") < SLIGHT * F.col("most")
    told = slots.join(most, "host").groupBy("host").agg(F.collect_list(F.when(menu, F.col("slot"))).alias("menus"), F.collect_list(F.when(notice, F.col("slot"))).alias("notices"))
    done = common.written(known.join(told, "host", "left").select("host", "classes", "texts", "menus", "notices"), "page-templates")
    for df in (drawn, found, known):
        common.dropped(spark, df)
    return done


def main_text(page: str | None, template: Template) -> str:
    """Text of the page's content slots under its host's template: blocks in page
    order, joined by an empty line."""
    found = pieces(page)
    slots, _ = template.walk([x.token for x in found])
    own = [(x, slot) for x, slot in zip(found, slots) if x.kind == "text"]
    marked = any(x.main for x, _ in own)
    if marked:
        own = [(x, slot) for x, slot in own if x.main]
    kept = [x for x, slot in own if slot not in template.menus and (marked or x.heading or slot not in template.notices)] or [x for x, _ in own]
    fresh = [x for x in kept if x.token not in template.texts]
    # Where an article is mostly what other pages of the host say too, it is a copy and not the site's own phrases.
    if fresh and (not marked or 2 * sum(len(x.text) for x in fresh) >= sum(len(x.text) for x in kept)):
        kept = fresh
    elif not fresh and not marked:
        kept = []
    return "\n\n".join(x.text for x in kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page, however long.

    Null and empty html: an empty text. Pages whose url is null or names no host
    share the host ''. Repeated rows are answered once each and count as pages
    of their host; an empty table gives no rows. Other columns are not read,
    whatever their names."""
    spark = pages.sparkSession
    common.prepare(spark)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    known = templates(rows.select("host", F.xxhash64("page_id", "url").alias("key"), "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: dict[str, Template] = {}
            out = []
            for host, page, *told in zip(batch.column("host").to_pylist(), batch.column("html"), *(batch.column(c) for c in ("classes", "texts", "menus", "notices"))):
                template = kept.get(host) or kept.setdefault(host, Template(*(x.as_py() or [] for x in told)))
                out.append(main_text(page.as_py(), template))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    # A template row of a host is small: broadcast while Spark finds all of them small, else shuffled, where a host with very many pages is split.
    return rows.join(known, "host", "left").select("page_id", "url", "html", "host", "classes", "texts", "menus", "notices").mapInArrow(run, f"{kinds}, text string, n_chars long")
