"""News links of listing pages, with the title, summary, date and image that stand around them.

One walk over a page's tree, in Arrow batches, describes every anchor and the box it stands in; which anchors are news,
what their labels say and which of several anchors of one address stays are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..functions import dates, links, text, urls
from . import html

# Fixed values.
ARTICLE_HINTS = ["article", "blog", "card", "content", "entry", "item", "lista", "noticia", "news", "post"]
NAVIGATION_HINTS = ["breadcrumb", "footer", "menu", "nav", "pagin", "pagination", "sidebar", "social", "topbar"]
IMAGE_ATTRIBUTES = ["src", "data-src", "data-lazy-src", "data-original"]
SUMMARY_NAMES, DATE_NAMES = "excerpt|resumo|summary|descricao|description", "date|data|posted|published"
CONTEXT_LEVELS, BOX_LEVELS = 5, 7
#: Characters of anchors that a task holds as objects; bounds memory only.
PORTION = 1 << 22
LABEL = r"(?i)^(\d{1,2}\s+[A-Za-zÀ-ÿ]{3,})\s*-\s*Publicado por\s+(.+)$"
LOOSE_DATE = r"(?i)\b(?:\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}\s+de\s+[A-Za-zÀ-ÿ]+(?:\s+de\s+\d{4})?|\d{1,2}\s+[A-Za-zÀ-ÿ]{3,})\b"

_TEXTS, _LISTS = ("href", "label", "heading", "visible"), ("summaries", "stamps", "images")
ANCHOR = StructType([StructField(n, StringType()) for n in _TEXTS] + [StructField(n, BooleanType()) for n in ("navigation", "inside")] + [StructField(n, ArrayType(StringType())) for n in _LISTS])


def _names(node: html.Node) -> str:
    """Tag, classes, id and role: hints may stand anywhere inside."""
    return " ".join([node.tag, *(node.attrs.get(a, "") for a in ("class", "id", "role"))]).lower()


def _above(node: html.Node, levels: int) -> list[html.Node]:
    found: list[html.Node] = []
    while node.parent is not None and len(found) < levels:
        node = node.parent
        found.append(node)
    return found


def _hinted(nodes: list[html.Node], hints: list[str]) -> bool:
    return any(h in names for names in map(_names, nodes) for h in hints)


def _described(box: html.Node) -> dict:
    inside = list(box.walk())
    named = lambda pattern: [n.text() for n in inside if re.search(pattern, n.attrs.get("class", ""), re.IGNORECASE)][:1]
    times = [n for n in inside if n.tag == "time"][:1]
    pictures = [n for n in inside if n.tag == "img"][:1]
    headings = sorted((n.tag, i, n.text()) for i, n in enumerate(inside) if n.tag in ("h1", "h2", "h3", "h4"))
    first_of_each = {tag: words for tag, _, words in reversed(headings)}
    return {
        "heading": next((first_of_each[t] for t in sorted(first_of_each) if first_of_each[t]), ""), "visible": box.text(), "summaries": named(SUMMARY_NAMES) + [n.text() for n in inside if n.tag == "p"],
        "stamps": [s for n in times for s in (n.text(), n.attrs.get("datetime", ""))] + named(DATE_NAMES),
        "images": [s for n in pictures for s in (*(n.attrs.get(a, "") for a in IMAGE_ATTRIBUTES), n.attrs.get("srcset", "").split(",")[0].strip().split(" ")[0]) if s],
    }


def anchors_of(page: str | None) -> list[dict]:
    if not page:
        return []
    builder = html.TreeBuilder()
    builder.feed(html.closed_references(page))
    builder.close()
    boxes: dict[int, dict] = {}
    found = []
    for n in builder.root.walk():
        if n.tag != "a" or "href" not in n.attrs:
            continue
        near = _above(n, CONTEXT_LEVELS)
        box = next((b for b in _above(n, BOX_LEVELS) if b.tag == "li" or _hinted([b], ARTICLE_HINTS)), n.parent)
        if id(box) not in boxes:  # many anchors share a box, which is walked once
            boxes[id(box)] = _described(box)
        picture = next((c for c in n.walk() if c.tag == "img"), None)
        labels = [n.text(), n.attrs.get("title", ""), n.attrs.get("aria-label", "")] + ([picture.attrs.get("alt", ""), picture.attrs.get("title", "")] if picture else [])
        label = next((" ".join(x.split()) for x in labels if x.strip()), "")
        found.append({"href": n.attrs["href"], "label": label, "navigation": _hinted(near, NAVIGATION_HINTS), "inside": _hinted(near, ARTICLE_HINTS), **boxes[id(box)]})
    html.free(builder.root)
    return found


def split_label(label: Column, publishers: list[str]) -> Column:
    """(title, date_label, publisher) of ``10 Out - Publicado por UNIT TITLE``; other labels are all title.

    The longest of the publishers that the rest begins with counts, whatever its accents and case; else the first three
    words of a rest that begins with ``campus``.
    """
    whole = text.collapse(label)
    rest = text.collapse(F.regexp_extract(whole, LABEL, 2))
    plain = lambda x: F.lower(text.strip_accents(x))
    fits = F.filter(F.lit(sorted(publishers, key=lambda p: (-len(p), p))), lambda p: F.startswith(plain(rest), plain(p))) if publishers else F.array().cast("array<string>")
    words = F.split(rest, " ")
    campus = F.when(F.startswith(F.lower(rest), F.lit("campus ")), F.when(F.size(words) >= 3, F.array_join(F.slice(words, 1, 3), " ")).otherwise(rest))
    publisher = F.coalesce(F.get(fits, F.lit(0)), campus, F.lit(""))
    title = F.coalesce(F.nullif(text.collapse(F.substr(rest, F.length(publisher) + 1, F.length(rest))), F.lit("")), rest)
    known = whole.rlike(LABEL)
    return F.struct(F.when(known, title).otherwise(whole).alias("title"), F.when(known, F.regexp_extract(whole, LABEL, 1)).otherwise("").alias("date_label"), F.when(known, publisher).otherwise("").alias("publisher"))


FIELDS = ["label", "title", "summary", "date_label", "publisher", "image"]


def _portions(found: Iterable[tuple[int, int, dict]]) -> Iterator[list[tuple[int, int, dict]]]:
    """Anchors in lists of about PORTION characters, one at least: each has the text of its box, which many may share."""
    part, size = [], 0
    for one in found:
        part.append(one)
        size += 200 + len(one[2]["visible"]) + sum(map(len, one[2]["summaries"]))
        if size > PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


def anchor_rows(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row for each anchor of a page that leads somewhere, with what stands around it."""
    held = pages.select(key, F.col(url).alias("base"), F.col(page).alias("_page"))
    schema = StructType([held.schema[key], held.schema["base"], StructField("position", IntegerType()), *ANCHOR.fields])
    arrow, kind = to_arrow_schema(schema), to_arrow_type(ANCHOR)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = ((i, batch.column(2)[i].as_py()) for i in range(batch.num_rows))
            for part in _portions((i, place, a) for i, p in pages for place, a in enumerate(anchors_of(p))):
                at = pa.array([i for i, _, _ in part], pa.int32())
                said = pa.array([a for _, _, a in part], kind).flatten()
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array([x for _, x, _ in part], pa.int32()), *said]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    rows = held.mapInArrow(read, schema)
    return rows.withColumn("address", urls.resolve(F.col("href"), F.col("base"))).where("address is not null")


def described(rows: DataFrame, publishers: list[str]) -> DataFrame:
    """Anchors that have a kind, with FIELDS and how many of them are filled."""
    rows = rows.withColumns({"legacy": split_label(F.col("label"), publishers), "boxed": F.col("kind") != "legacy_article"})
    in_box = lambda found, other: F.when(F.col("boxed"), found).otherwise(other)
    first = lambda options: F.coalesce(F.get(options, F.lit(0)), F.lit(""))
    rows = rows.withColumn("title", in_box(F.coalesce(F.nullif("heading", F.lit("")), "label"), F.col("legacy.title")))
    plain = lambda x: F.lower(text.strip_accents(x))
    summary = first(F.filter("summaries", lambda s: (s != "") & (plain(s) != plain(F.col("title"))) & ~dates.looks_like_date(s)))
    stamp = F.coalesce(F.get(F.filter("stamps", lambda s: s != ""), F.lit(0)), F.regexp_extract("visible", LOOSE_DATE, 0))
    image = first(F.filter(F.transform("images", lambda s: urls.resolve(s, F.col("base"))), lambda s: s.isNotNull()))
    rows = rows.withColumns({"summary": in_box(summary, F.lit("")), "date_label": in_box(stamp, F.col("legacy.date_label")), "publisher": F.col("legacy.publisher"), "image": in_box(image, F.lit(""))})
    rows = rows.withColumn("publisher", in_box(F.lit(""), F.col("publisher")))
    return rows.withColumn("quality", links.candidate_quality(*map(F.col, FIELDS[1:])))


def news_links(pages: DataFrame, own_domain: str, legacy_host: str, publishers: list[str], key: str = "page_id", url: str = "url", page: str = "html", most: int | None = None) -> DataFrame:
    """One row for each news address of a page, placed by its first anchor; the anchor that fills most fields describes it.

    Pages without text, and links that lead nowhere or to no news, give no row. ``most`` keeps the first addresses of a page.
    """
    rows = anchor_rows(pages, key, url, page)
    rows = rows.withColumn("kind", links.news_kind(F.col("address"), F.col("label"), F.col("navigation"), F.col("inside"), own_domain, legacy_host)).where("kind is not null")
    rows = described(rows, publishers)
    best = F.max_by(F.struct("href", "kind", *FIELDS), F.struct("quality", -F.col("position")))
    found = rows.groupBy(key, "address").agg(best.alias("best"), F.min("position").alias("position"))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("position")))
    found = found.select(key, "place", "address", "best.*").withColumn("relative_href", urls.relative(F.col("href")))
    return found if most is None else found.where(F.col("place") <= most)


def discover(found: DataFrame, source: str, page: str) -> DataFrame:
    """Each normalised address of the listing pages of all sources: its first place, and how often it was met."""
    rows = found.withColumn("normalized", urls.normalize_url(F.col("address")))
    return rows.groupBy("normalized").agg(F.min_by(F.struct(source, page, "address", "title", "kind"), F.struct(source, page, "place")).alias("first"), (F.count("*") - 1).alias("alternatives")).select("normalized", "first.*", "alternatives")
