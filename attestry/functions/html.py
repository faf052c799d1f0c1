"""Web pages: one small Arrow function lists a page's elements with the stretches of text inside them, and column expressions
take all else from the list."""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import contacts

# Elements without an end, selectors of what is dropped, of main texts and addresses, hosts of platforms, and marks of
# pages that a script fills.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
DROPPED = ["script", "style", "nav", "footer", ".sidebar", ".ads", ".advertisement"]
MAIN = ["main", "article", "[role=main]", ".content", ".main-content", ".post-content", ".entry-content", ".page-content"]
ADDRESSES = ["address", "[itemprop=address]", ".address", ".location", ".contact-address", "[data-address]", ".footer-address"]
PLATFORMS = [
    ("facebook", r"facebook\.com|fb\.com"),
    ("twitter", r"twitter\.com|x\.com"),
    ("linkedin", r"linkedin\.com"),
    ("youtube", r"youtube\.com|youtu\.be"),
    ("instagram", r"instagram\.com"),
]
SPA_MARKS = ["div[ng-app]", "[data-reactroot]", "[data-react]", ".app--root", ".nuxt-child", "[v-app]"]
# End of fixed values.

NODE = "struct<tag:string,attrs:map<string,string>,classes:array<string>,hidden:boolean,begin:int,end:int,seen_begin:int,seen_end:int>"
LISTED = f"struct<nodes:array<{NODE}>,text:binary,seen:binary>"


class _Lister(HTMLParser):
    """Elements of a page in document order, each with the stretch of the page's text that lies in it, in bytes of UTF-8:
    of all text, and of what is seen, that is, outside dropped elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.text, self.seen = bytearray(), bytearray()
        self.hiding = 0

    def add(self, tag: str, attrs: list) -> dict:
        told = {k: v or "" for k, v in attrs}
        node = {"tag": tag, "attrs": list(told.items()), "classes": told.get("class", "").split(), "begin": len(self.text), "seen_begin": len(self.seen)}
        dropped = tag in _DROPPED_TAGS or not _DROPPED_CLASSES.isdisjoint(node["classes"])
        node["hidden"] = dropped or self.hiding > 0
        node["dropped"] = dropped
        self.nodes.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        node = self.add(tag, attrs)
        if tag in VOID:
            self.ended(node)
        else:
            self.hiding += node["dropped"]
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.ended(self.add(tag, attrs))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                self.close_to(depth)
                return

    def handle_data(self, data):
        raw = data.encode("utf-8", "replace")
        self.text += raw
        if not self.hiding:
            self.seen += raw

    def ended(self, node: dict) -> None:
        node["end"], node["seen_end"] = len(self.text), len(self.seen)

    def close_to(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.hiding -= node["dropped"]
            self.ended(node)
        del self.open[depth:]


_DROPPED_TAGS = frozenset(s for s in DROPPED if not s.startswith("."))
_DROPPED_CLASSES = frozenset(s[1:] for s in DROPPED if s.startswith("."))


def list_nodes(html: str | None) -> dict:
    lister = _Lister()
    lister.feed(html or "")
    lister.close()
    lister.close_to(0)
    return {"nodes": lister.nodes, "text": bytes(lister.text), "seen": bytes(lister.seen)}


def with_nodes(pages: DataFrame, html_col: str = "html", out: str = "listed") -> DataFrame:
    """Add the elements of a page and its texts: (``nodes``, ``text``, ``seen``). An element's text is the stretch from its begin to its end,
    so none is looked for among the nodes, and the work is in proportion to the page."""
    ship(pages.sparkSession)
    node = pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("classes", pa.list_(pa.string())), ("hidden", pa.bool_()), *[(n, pa.int32()) for n in ("begin", "end", "seen_begin", "seen_end")]])
    kind = pa.struct([("nodes", pa.list_(node)), ("text", pa.binary()), ("seen", pa.binary())])

    @F.arrow_udf(LISTED)
    def read(htmls: pa.Array) -> pa.Array:
        return pa.array([list_nodes(h) for h in htmls.to_pylist()], kind)

    return pages.withColumn(out, read(F.col(html_col)))


# Expressions over node lists ---------------------------------------------------------------------------------


def attribute(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def matches(node: Column, selector: str) -> Column:
    """A tag, ``.class``, ``#id``, ``[name]`` or ``[name=value]``, or a tag with one of these."""
    at = min((selector.find(c) for c in ".#[" if c in selector), default=len(selector))
    tag, mark = selector[:at], selector[at:]
    conds = [node["tag"] == tag] if tag else []
    if mark.startswith("."):
        conds.append(F.array_contains(node["classes"], mark[1:]))
    elif mark.startswith("#"):
        conds.append(F.coalesce(attribute(node, "id") == mark[1:], F.lit(False)))
    elif mark:
        name, _, value = mark[1:-1].partition("=")
        conds.append(F.coalesce(attribute(node, name) == value, F.lit(False)) if value else attribute(node, name).isNotNull())
    return reduce(lambda a, b: a & b, conds)


def select(nodes: Column, *selectors: str) -> Column:
    """Elements that match one of the selectors, in order."""
    return F.filter(nodes, lambda n: reduce(lambda a, b: a | b, [matches(n, s) for s in selectors]))


def text_of(text: Column, node: Column) -> Column:
    """All text inside an element."""
    return F.substring(text, node["begin"] + 1, node["end"] - node["begin"]).cast("string")


def seen_of(seen: Column, node: Column) -> Column:
    """The text inside an element that is not dropped."""
    return F.substring(seen, node["seen_begin"] + 1, node["seen_end"] - node["seen_begin"]).cast("string")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " "))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def absolute(href: Column, base: Column) -> Column:
    """Address that a link leads to from a page, null if there is none."""
    root = F.nullif(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.lit(""))
    folder = F.concat(root, F.regexp_replace(F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"[^/]*$", ""))
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    return (
        F.when(F.rlike(href, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("#")) | F.startswith(href, F.lit("?")), F.concat(page, href))
        .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), href))
    )


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _last_wins(entries: Column) -> Column:
    """Map of (key, value) entries; of equal keys the last counts."""
    first_of = lambda held, keys: F.transform(F.array_distinct(keys), lambda k: F.element_at(held, F.array_position(keys, k).cast("int")))
    return F.map_from_entries(_let(F.reverse(entries), lambda held: _let(F.transform(held, lambda e: e["key"]), lambda keys: first_of(held, keys))))


def extract_pages(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """All columns of ``pages`` plus the record of each page. E-mail addresses and phones come from the raw page, state,
    postal code and claims from the whole main text; JSON-LD blocks that do not parse are dropped. What is dropped (scripts,
    navigation) counts for titles, headings and JSON-LD only. Null pages give empty parts."""
    raw = F.coalesce(F.col(html_col), F.lit(""))
    listed = with_nodes(pages.select(F.struct("*").alias("own"), raw.alias("raw"), F.coalesce(F.col(url_col), F.lit("")).alias("base")), "raw")
    nodes, text, seen = F.col("nodes"), F.col("text"), F.col("seen")
    placed = listed.select("own", "raw", "base", "listed.*").withColumn("kept", F.filter(nodes, lambda n: ~n["hidden"]))
    kept = F.col("kept")

    metas = F.filter(F.transform(select(nodes, "meta"), lambda n: F.struct(F.coalesce(F.nullif(attribute(n, "name"), F.lit("")), F.nullif(attribute(n, "property"), F.lit(""))).alias("key"), F.nullif(attribute(n, "content"), F.lit("")).alias("value"))), lambda m: m["key"].isNotNull() & m["value"].isNotNull())
    parts = placed.select(
        "own", "raw", "base", "kept", "seen",
        _last_wins(metas).alias("meta_tags"),
        F.try_element_at(F.transform(select(nodes, "title"), lambda n: trimmed(text_of(text, n))), F.lit(1)).alias("title_text"),
        F.filter(F.transform(F.filter(select(nodes, "script"), lambda n: attribute(n, "type") == "application/ld+json"), lambda n: trimmed(text_of(text, n))), lambda j: F.try_parse_json(j).isNotNull()).alias("json_ld"),
        F.filter(F.transform(select(nodes, "h1", "h2", "h3", "h4", "h5", "h6"), lambda n: trimmed(text_of(text, n))), lambda t: t != "").alias("headings"),
        F.coalesce(*[F.nullif(F.array_join(F.transform(select(kept, s), lambda n: seen_of(seen, n)), ""), F.lit("")) for s in [*MAIN, "body"]], F.lit("")).alias("main"),
    )
    texts = lambda selector: F.transform(select(kept, selector), lambda n: squeezed(seen_of(seen, n)))
    links = F.filter(F.transform(F.filter(select(kept, "a"), lambda n: F.coalesce(attribute(n, "href"), F.lit("")) != ""), lambda n: F.struct(trimmed(seen_of(seen, n)).alias("title"), absolute(attribute(n, "href"), F.col("base")).alias("url"))), lambda x: x["url"].isNotNull())
    parts = parts.withColumn("main", squeezed(F.col("main"))).withColumn("links", links)
    away = lambda url: host_of(url) != host_of(F.col("base"))
    platform = lambda url: reduce(lambda c, p: c.when(F.rlike(url, F.lit(f"(?i){p[1]}")), F.lit(p[0])), PLATFORMS[1:], F.when(F.rlike(url, F.lit(f"(?i){PLATFORMS[0][1]}")), F.lit(PLATFORMS[0][0])))
    meta = lambda *names: F.coalesce(*[F.try_element_at("meta_tags", F.lit(n)) for n in names])
    empty_root = F.exists(select(kept, "#root", "#app"), lambda n: F.length(trimmed(seen_of(seen, n))) < 50)
    chars = F.length("main")
    scripted = (
        F.exists(select(kept, "meta"), lambda n: F.lower(F.coalesce(attribute(n, "http-equiv"), F.lit(""))) == "refresh")
        | (F.size(select(kept, *SPA_MARKS)) > 0)
        | (empty_root & (chars < 100))
        | ((chars < 50) & (F.size(select(kept, "h1", "h2", "main", "article", "section")) == 0))
    )
    return parts.select(
        "own.*",
        F.coalesce(meta("og:title", "title"), F.nullif("title_text", F.lit(""))).alias("title"),
        meta("description", "og:description").alias("description"),
        "headings",
        F.col("main").alias("main_text"),
        contacts.emails(F.col("raw")).alias("emails"),
        contacts.phones(F.col("raw")).alias("phones"),
        F.array_distinct(F.filter(F.flatten(F.array(*[texts(s) for s in ADDRESSES])), lambda t: F.length(t) > 5)).alias("addresses"),
        F.transform(F.filter("links", lambda x: away(x["url"]) & platform(x["url"]).isNotNull()), lambda x: F.struct(platform(x["url"]).alias("platform"), x["url"].alias("url"))).alias("social_links"),
        F.transform(F.filter("links", lambda x: x["title"] != ""), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), F.when(away(x["url"]), "external").otherwise("internal").alias("type"))).alias("outbound_links"),
        "json_ld",
        "meta_tags",
        contacts.detect_state(F.col("main")).alias("detected_state"),
        contacts.pin_code(F.col("main")).alias("detected_pin_code"),
        contacts.affiliation(F.col("main")).alias("affiliation"),
        contacts.approval(F.col("main")).alias("approval"),
        scripted.alias("needs_javascript"),
    )


def title_tag(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)), F.lit(""))


def heading_texts(html: Column) -> Column:
    """Headings as a regex sees them: tags inside are dropped."""
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return F.filter(F.transform(inner, lambda h: F.trim(F.regexp_replace(h, "<[^>]+>", ""))), lambda h: h != "")
