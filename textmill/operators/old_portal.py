"""Articles of an old portal: which node holds the text, and what its lines are.

One walk of a page's tree, in Arrow batches, lays all its text out once; every node is a range of it, so the scores of
all nodes (characters, paragraphs, links to documents, whether title, dates or menu phrases stand inside) come from
prefix sums and sorted places and not from a walk for each node. What a line is (title, author, heading of the documents,
crumb) and where the body ends are column expressions over the lines.

Null and empty pages give empty lines and empty fields. A reference without its semicolon, as where a text was cut, is text,
but ``&amp``. A page without a node that scores above 0 has no content. Of
nodes with equal scores the first candidate counts. Titles are compared by their key; an empty title begins at the top.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text
from . import html

# Fixed values.
HIDDEN = {"script", "style", "noscript", "svg", "form"}
SELECTORS = ["#barra_central", ".itens_noticia", "main", "article", "#content", "#conteudo", "#corpo", "#corpo_geral", ".content", ".conteudo", ".noticia", ".post", ".texto", ".principal", ".miolo"]
NAMED_BOXES = re.compile(r"(content|conteudo|noticia|post|texto|principal|miolo|barra_central|corpo)", re.IGNORECASE)
BONUS = {"barra_central": 650, "itens_noticia": 450, "corpo": 120}
MENU_PHRASES = ["acesso a informacao", "institucional", "processo seletivo", "servicos", "sistemas", "boletim de servicos", "gerenciamento do site"]
EMPTY_KEYS = ["inicio", "noticias", "documentos"]
BLOCK_TAGS = {"h1", "h2", "h3", "h4", "p", "li", "blockquote"}
DOCUMENT_ENDINGS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar"]
DOCUMENT_WORDS = ["edital", "anexo", "formulario", "ficha", "resultado", "cronograma", "retificacao", "arquivo", "documento", "clique aqui", "acesse aqui", "chamada", "lista", "inscricao", "homologacao", "convocacao"]
DOCUMENT_ADDRESS = "/get_file/"
ANY_DATE = [r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{1,2}\s+de\s+[\wÀ-ÿ]+\b", r"\b\d{1,2}\s+[\wÀ-ÿ]{3,}\b"]
PARAGRAPH, TITLE, DATE, LINK, NOISE, MENU = 90, 350, 120, 35, 1000, 90
LEAST_WORDS, LEAST_BODY, BEST = 20, 80, 20
BAD_TITLES = ["", "acesso a informacao", "institucional", "estudante", "eventos", "servicos", "biblioteca", "processo seletivo", "sistemas", "email institucional", "ativa incubadora", "cursos", "a rede", "documentos"]
CRUMBS, DOCUMENT_HEADINGS = ["inicio", "noticias", "inicio noticias"], ["documentos"]
ENDS, MORE_ENDS = ["cursos", "a rede"], ["noticias", "inicio"]
DAY, SLASHED = r"\d{1,2}\s+de\s+[\wÀ-ÿ]+(?:\s+de\s+\d{4})?", r"\d{1,2}/\d{1,2}/\d{2,4}"
CLOCK = r"(?:\s+(?:as|às)\s+\d{1,2}:\d{2})?"
LABELLED = r"(?:Publicado em|Publicado:|Data de publica(?:\w+)?:?)\s*"
PORTAL_DATES = [LABELLED + rf"({SLASHED}(?:\s+\d{{1,2}}:\d{{2}})?)", LABELLED + f"({DAY}{CLOCK})", rf"(\b{SLASHED}\s+\d{{1,2}}:\d{{2}}\b)", rf"(\b{SLASHED}\b)", rf"(\b{DAY}{CLOCK}\b)", r"(\b\d{1,2}\s+[\wÀ-ÿ]{3,}\b)"]
LINE_DATES = [rf"(\b{SLASHED}\b)", r"(\b\d{1,2}\s+de\s+[A-Za-zÀ-ÿ]+(?:\s+de\s+\d{4})?\b)", r"(\b\d{1,2}\s+[A-Za-zÀ-ÿ]{3,}\b)"]
OFF_LINE, HEAD_OFFICE = "site desativado", "reitoria"


@dataclass(frozen=True)
class Portal:
    """What is the institution's own: the word that marks its author lines, and how its full name begins."""

    word: str
    name: str = ""


def key_of(words: str) -> str:
    """``text.text_key`` of a text in a task."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", words) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w\s]", " ", plain.lower()).split())


class Places:
    """Where something stands in a text: whether any of it is inside a range, by one search."""

    def __init__(self, spans: Iterable[tuple[int, int]]) -> None:
        ordered = sorted(spans)
        self.starts, self.ends = [s for s, _ in ordered], [e for _, e in ordered]
        for i in range(len(self.ends) - 2, -1, -1):
            self.ends[i] = min(self.ends[i], self.ends[i + 1])

    def inside(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, start)
        return i < len(self.ends) and self.ends[i] <= end

    @classmethod
    def of_words(cls, whole: str, words: str) -> Places:
        spans, at = [], whole.find(words) if words else -1
        while at >= 0:
            spans.append((at, at + len(words)))
            at = whole.find(words, at + 1)
        return cls(spans)

    @classmethod
    def of_patterns(cls, whole: str, patterns: list[str]) -> Places:
        return cls(m.span(1) for p in patterns for m in re.finditer(f"(?=({p}))", whole))


@dataclass
class Layout:
    """The lines of a page one after the other, and for each node the lines, characters and key characters it holds."""

    nodes: list[html.Node] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)
    whole: str = ""
    keys: str = ""
    spans: dict[int, tuple[int, int]] = field(default_factory=dict)
    extents: dict[int, tuple[int, int]] = field(default_factory=dict)
    at: list[tuple[int, int, int]] = field(default_factory=list)
    counts: dict[int, list[int]] = field(default_factory=dict)

    def text(self, n: html.Node) -> str:
        first, last = self.spans[id(n)]
        return " ".join(self.lines[first:last])

    def chars(self, n: html.Node) -> tuple[int, int]:
        """The range of a node in ``whole``; ranges hold the blank after each line."""
        first, last = self.spans[id(n)]
        return self.at[first][0], max(self.at[last][0] - 1, self.at[first][0])

    def key_chars(self, n: html.Node) -> tuple[int, int]:
        first, last = self.spans[id(n)]
        return self.at[first][1], max(self.at[last][1] - 1, self.at[first][1])

    def below(self, n: html.Node) -> list[html.Node]:
        """All nodes inside a node, parents first."""
        first, last = self.extents[id(n)]
        return self.nodes[first + 1 : last]

    def block(self, n: html.Node) -> str:
        """The text of a block; that of a paragraph ends where another block begins, as it was never closed."""
        first, last = self.spans[id(n)]
        inner = next((m for m in self.below(n) if m.tag in BLOCK_TAGS), None) if n.tag == "p" else None
        return " ".join(self.lines[first : self.spans[id(inner)][0] if inner is not None else last])

    def words(self, n: html.Node) -> int:
        first, last = self.spans[id(n)]
        return self.at[last][2] - self.at[first][2]


def _pieces(children: list) -> Iterator[html.Node | str]:
    """Children, with texts that a sign split put together."""
    run: list[str] = []
    for c in children:
        if isinstance(c, str):
            run.append(c)
            continue
        if run:
            yield "".join(run)
            run = []
        yield c
    if run:
        yield "".join(run)


def _lines(words: str) -> list[str]:
    return [line for raw in words.splitlines() if (line := " ".join(raw.split()))]


def documentary(href: str, label: str) -> bool:
    said = f"{href} {label}"
    key, low = key_of(said), said.lower()
    return any(w in key for w in DOCUMENT_WORDS) or any(e in low for e in DOCUMENT_ENDINGS) or DOCUMENT_ADDRESS in low


def layout(page: str) -> Layout:
    builder = html.TreeBuilder()
    builder.feed(html.closed_references(page))
    builder.close()
    found = Layout()
    open_at: dict[int, tuple[int, int]] = {}
    pending: list[tuple[html.Node | str, bool]] = [(builder.root, True)]
    while pending:
        item, entering = pending.pop()
        if isinstance(item, str):
            found.lines += _lines(item)
        elif entering:
            if item.tag in HIDDEN:
                continue
            open_at[id(item)] = (len(found.lines), len(found.nodes))
            found.nodes.append(item)
            pending.append((item, False))
            pending += [(c, True) for c in reversed(list(_pieces(item.children)))]
        else:
            first_line, first_node = open_at[id(item)]
            found.spans[id(item)], found.extents[id(item)] = (first_line, len(found.lines)), (first_node, len(found.nodes))
    keys = [key_of(line) for line in found.lines]
    found.whole, found.keys = " ".join(found.lines), " ".join(k for k in keys if k)
    chars = key_chars = words = 0
    found.at.append((0, 0, 0))
    for line, key in zip(found.lines, keys):
        chars, key_chars, words = chars + len(line) + 1, key_chars + (len(key) + 1 if key else 0), words + len(re.findall(r"\b[\wÀ-ÿ]+\b", line))
        found.at.append((chars, key_chars, words))
    # paragraphs, links and links to documents below each node: children come after their parents in ``nodes``
    found.counts = {id(n): [0, 0, 0] for n in found.nodes}
    for n in reversed(found.nodes):
        if n.parent is None:
            continue
        up, own = found.counts[id(n.parent)], found.counts[id(n)]
        link = n.tag == "a" and "href" in n.attrs
        for i, more in enumerate((n.tag == "p", link, link and documentary(n.attrs["href"], found.text(n)))):
            up[i] += own[i] + more
    return found


def _tokens(n: html.Node, *names: str) -> str:
    return " ".join(n.attrs[a] for a in names if n.attrs.get(a))


def _marked(n: html.Node) -> bool:
    return n.tag == "li" and "atual" in n.attrs.get("class", "").split()


def candidates(page: Layout, near_title: bool = True) -> list[html.Node]:
    """Nodes that may hold an article: by selector in order, then named boxes, then what stands around the title."""
    order = {s: [n for n in page.nodes if html.matches(n, s)] for s in SELECTORS}
    boxes = [n for n in page.nodes if n.tag in ("section", "div") and NAMED_BOXES.search(_tokens(n, "class", "id", "role", "aria-label"))]
    around = []
    node = next((n for n in page.nodes if _marked(n) or n.tag in ("h1", "h2")), None) if near_title else None
    for _ in range(4):
        node = node.parent if node is not None else None
        if node is not None and node.tag in ("div", "section", "article", "main"):
            around.append(node)
    return list({id(n): n for n in (*(n for s in SELECTORS for n in order[s]), *boxes, *around)}.values())


def scores(page: Layout, nodes: list[html.Node], title: str, name: str) -> list[int]:
    """How likely each node holds the article."""
    titles, dates = Places.of_words(page.keys, key_of(title)), Places.of_patterns(page.whole, ANY_DATE)
    menus = [Places.of_words(page.keys, p) for p in MENU_PHRASES]
    found = []
    for n in nodes:
        start, end = page.chars(n)
        at = page.key_chars(n)
        head = page.keys[at[0] : at[1]] if at[1] - at[0] <= 20 else page.keys[at[0] : at[0] + len(name)]
        useful = 0 if head in EMPTY_KEYS or (name and head.startswith(name)) else end - start
        names = _tokens(n, "class", "id").lower()
        score = useful + PARAGRAPH * page.counts[id(n)][0] + LINK * page.counts[id(n)][2] + TITLE * titles.inside(*at) + DATE * dates.inside(start, end)
        score += next((bonus for token, bonus in BONUS.items() if token in names), 0)
        score -= NOISE * bool(html.NOISE_NAMES.search(_tokens(n, "class", "id", "role", "aria-label"))) + MENU * sum(m.inside(*at) for m in menus)
        found.append(score)
    return found


def content(page: Layout, title: str, name: str) -> tuple[html.Node | None, int | None]:
    """The central bar, else a list of news, of enough words; else the candidate of the highest score above 0."""
    for selector in SELECTORS[:2]:
        for n in page.nodes:
            if html.matches(n, selector) and page.words(n) >= LEAST_WORDS:
                holds = selector == SELECTORS[1] or any(_marked(m) or html.matches(m, SELECTORS[1]) for m in page.below(n))
                at = page.key_chars(n)
                if holds or key_of(title) in page.keys[at[0] : at[1]]:
                    return n, None
    nodes = candidates(page)
    ranked = scores(page, nodes, title, name)
    best = max(range(len(nodes)), key=ranked.__getitem__, default=None)
    return (nodes[best], ranked[best]) if best is not None and ranked[best] > 0 else (None, None)


def _described(n: html.Node) -> str:
    return n.tag + (f"#{n.attrs['id']}" if n.attrs.get("id") else "") + "".join(f".{c}" for c in n.attrs.get("class", "").split())


_LISTS = ("lines", "blocks", "inside")
PAGE = StructType([StructField("title", StringType()), StructField("node", StringType()), StructField("score", IntegerType()), *(StructField(n, ArrayType(StringType())) for n in _LISTS), StructField("documents", ArrayType(StructType([StructField("href", StringType()), StructField("text", StringType())])))])


def parse(page: str | None, listed: str | None, name: str) -> dict:
    found = layout(page or "")
    node, score = content(found, listed or "", name)
    empty = {"title": "", "node": None, "score": None, "lines": found.lines, "blocks": [], "inside": [], "documents": []}
    if node is None:
        html.free(found.nodes[0])
        return empty
    below = found.below(node)
    heads = [n for n in below if _marked(n) or n.tag in ("h1", "h2", "h3")]
    marked = {id(n) for n in below if _marked(n)}
    for n in below:  # parents come first, so what is inside a marked item is marked too
        if n.parent is not None and id(n.parent) in marked:
            marked.add(id(n))
    blocks = [found.block(n) for n in below if n.tag in BLOCK_TAGS and (id(n) not in marked or id(n.parent) not in marked)]
    links = [{"href": n.attrs["href"], "text": found.text(n)} for n in below if n.tag == "a" and "href" in n.attrs]
    first, last = found.spans[id(node)]
    described = _described(node)
    html.free(found.nodes[0])
    return {**empty, "title": found.text(heads[0]) if heads else "", "node": described, "score": score, "blocks": blocks, "inside": found.lines[first:last], "documents": [x for x in links if documentary(x["href"], x["text"])]}


def portal_page(page: Column, listed: Column, portal: Portal) -> Column:
    """Title, blocks, lines and links to documents of the node that holds the article, and all lines of the page."""
    name = portal.name

    @F.arrow_udf(PAGE)
    def parsed(pages: pa.Array, titles: pa.Array) -> pa.Array:
        return html.in_pieces(PAGE, lambda p, t: parse(p, t, name), pages, titles)

    return parsed(page, listed)


BLOCK = StructType([*(StructField(n, StringType()) for n in ("selector", "tag", "id", "classes")), *(StructField(n, IntegerType()) for n in ("chars", "words", "paragraphs", "links")), StructField("preview", StringType())])


def blocks_of(page: str | None) -> list[dict]:
    """The candidates of most characters, at most BEST; the first of equals first."""
    found = layout(page or "")
    sized = ((found.chars(n)[1] - found.chars(n)[0], -i, n) for i, n in enumerate(candidates(found, near_title=False)))
    best = [
        {"selector": _described(n), "tag": n.tag, "id": n.attrs.get("id", ""), "classes": n.attrs.get("class", ""), "chars": chars, "words": found.words(n), "paragraphs": found.counts[id(n)][0], "links": found.counts[id(n)][1], "preview": found.whole[slice(*found.chars(n))][:240]}
        for chars, _, n in heapq.nlargest(BEST, sized, key=lambda x: x[:2])
    ]
    html.free(found.nodes[0])
    return best


@F.arrow_udf(ArrayType(BLOCK))
def content_blocks(pages: pa.Array) -> pa.Array:
    return html.in_pieces(ArrayType(BLOCK), blocks_of, pages)


def lines_of(page: str | None) -> list[str]:
    """The lines of :func:`layout` alone."""
    builder = html.TreeBuilder()
    builder.feed(html.closed_references(page or ""))
    builder.close()
    found: list[str] = []
    pending: list[html.Node | str] = [builder.root]
    while pending:
        item = pending.pop()
        if isinstance(item, str):
            found += _lines(item)
        elif item.tag not in HIDDEN:
            pending += reversed(list(_pieces(item.children)))
    html.free(builder.root)
    return found


@F.arrow_udf(ArrayType(StringType()))
def lines(pages: pa.Array) -> pa.Array:
    """The lines of text of a page, hidden elements left out."""
    return html.in_pieces(ArrayType(StringType()), lines_of, pages)


# What a line is.


def spoken_key(x: Column) -> Column:
    """Lower-case letters with their accents, and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text.normalize_space(x)), "[^a-z0-9À-ÿ]+", " "))


def _own(line: Column, longest: int, words: int) -> Column:
    return F.contains(line, F.lit("/")) & (F.length(line) <= longest) & (F.size(F.split(F.trim(line), r"\s+")) <= words)


def author_line(line: Column, portal: Portal, key: Column | None = None) -> Column:
    """Tests on lines take the line's key too, where it is there already: in a lambda nothing is computed once by itself."""
    key = text.text_key(line) if key is None else key
    return ~F.startswith(key, F.lit(OFF_LINE)) & (key.rlike(r"\b(ascom|assessoria|comunica)") | (F.contains(key, F.lit(portal.word)) & _own(line, 140, 10)))


def strict_author_line(line: Column, portal: Portal, key: Column | None = None) -> Column:
    """As in a diagnosis: whole words, accents as they stand, a shorter line."""
    key = spoken_key(line) if key is None else key
    return ~F.startswith(key, F.lit(OFF_LINE)) & (key.rlike(r"(?U)\b(ascom|assessoria|comunicacao|comunicação)\b") | (key.rlike(rf"(?U)\b{re.escape(portal.word)}\b") & _own(line, 120, 8)))


def publisher_of(author: Column) -> Column:
    """The head office, or the campus that an author line names; else empty."""
    campus = F.regexp_extract(author, r"(?i)campus\s+([A-Za-zÀ-ÿ0-9 \-]+)", 1)
    return F.when(F.contains(text.text_key(author), F.lit(HEAD_OFFICE)), HEAD_OFFICE.capitalize()).when(campus != "", text.normalize_space(F.concat(F.lit("Campus "), campus))).otherwise("")


def document_heading(line: Column, key: Column | None = None) -> Column:
    return (text.text_key(line) if key is None else key).isin(DOCUMENT_HEADINGS) | F.rtrim(F.lower(line), F.lit(".")).rlike("(" + "|".join(map(re.escape, DOCUMENT_ENDINGS)) + ")$")


def document_title(line: Column) -> Column:
    return F.lower(line).rlike(r"\.(pdf|docx?|xlsx?)$|^(edital |instrucao normativa|instrução normativa)")


def crumb(line: Column, key: Column | None = None) -> Column:
    return (text.text_key(line) if key is None else key).isin(CRUMBS) | F.startswith(F.trim(line), F.lit(">>"))


def bad_title(title: Column, portal: Portal) -> Column:
    key = text.text_key(title)
    return key.isin(BAD_TITLES) | (F.startswith(key, F.lit(portal.name)) if portal.name else F.lit(False))


def first_of(x: Column, patterns: list[str]) -> Column:
    """The first match of the first pattern that has one; empty if none has."""
    tried = [F.nullif(text.normalize_space(F.regexp_extract(x, "(?iU)" + p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*tried, F.lit(""))


# Lines as fields.


def _first(rows: Column, test: Callable[[Column], Column]) -> Column:
    """The place of the first line that a test holds for, from 1; 0 if it holds for none."""
    return F.array_position(F.transform(rows, lambda x: F.coalesce(test(x), F.lit(False))), True)


def _from(rows: Column, start: Column) -> Column:
    return F.slice(rows, start.cast("int"), F.greatest(F.size(rows), F.lit(0)))


def _before(rows: Column, end: Column) -> Column:
    """The lines before a place; all if it is 0."""
    return text.let(end, lambda e: F.when(e > 0, F.slice(rows, F.lit(1), (e - 1).cast("int"))).otherwise(rows))


def _keyed(rows: Column, key: Callable[[Column], Column]) -> Column:
    """Lines with their keys, so that no test makes them again."""
    return F.transform(rows, lambda x: F.struct(x.alias("line"), key(x).alias("key")))


def _bare(keyed: Column) -> Column:
    return F.transform(keyed, lambda x: x["line"])


def line_scan(rows: Column, title: Column, portal: Portal) -> Column:
    """(date_label, author, publisher, words, preview) of the lines that follow the title, as a diagnosis reads a page.

    The title is the first line with its key, else the first that holds it. The body ends at the menu of the foot, at the
    documents and at the title of a document; the first author line is no part of it. Without a title there is no body.
    """
    ends = lambda x: x["key"].isin([*ENDS, *DOCUMENT_HEADINGS]) | document_title(x["line"])

    def after(said: Column, key: Column) -> Column:
        place = text.let(_first(said, lambda x: x["key"] == key), lambda exact: F.when(key == "", 0).when(exact > 0, exact).otherwise(_first(said, lambda x: F.contains(x["key"], key))))
        return text.let(place, lambda s: F.when(s > 0, _from(said, s + 1)).otherwise(F.slice(said, 1, 0)))

    def fields(author: Column, body: Column) -> Column:
        dated = F.when(body == "", F.array_join(rows, "\n")).otherwise(body)
        return F.struct(first_of(dated, LINE_DATES).alias("date_label"), author.alias("author"), publisher_of(author).alias("publisher"), text.word_count(body).alias("words"), F.left(text.normalize_space(body), F.lit(500)).alias("preview"))

    def parted(held: Column, place: Column) -> Column:
        rest = F.when(place > 0, F.concat(F.slice(held, F.lit(1), (place - 1).cast("int")), _from(held, place + 1))).otherwise(held)
        author = F.when(place > 0, F.try_element_at(held, place.cast("int"))["line"]).otherwise("")
        return text.let(F.array_join(_bare(rest), "\n\n"), lambda body: fields(author, body))

    def scanned(found: Column) -> Column:
        held = text.let(found, lambda a: _before(a, _first(a, ends)))
        return text.let(held, lambda h: text.let(_first(h, lambda x: strict_author_line(x["line"], portal, x["key"])), lambda place: parted(h, place)))

    return text.let(F.struct(_keyed(rows, spoken_key).alias("said"), spoken_key(title).alias("key")), lambda v: scanned(after(v["said"], v["key"])))


def body_lines(keyed: Column, key: Column, portal: Portal, ends: list[str]) -> Column:
    """The lines between the title and the documents or the foot, without crumbs, author lines and repeats of the title; of lines with their keys, and the title's key."""
    start = _first(keyed, lambda x: x["key"] == key)
    after = text.let(start, lambda s: F.when(key == "", keyed).when(s > 0, _from(keyed, s + 1)).otherwise(F.slice(keyed, 1, 0)))
    over = lambda x: (document_heading(x["line"], x["key"]) | x["key"].isin(ends)) & ~crumb(x["line"], x["key"])
    kept = text.let(after, lambda a: _before(a, _first(a, over)))
    return _bare(F.filter(kept, lambda x: (x["key"] != key) & ~crumb(x["line"], x["key"]) & ~author_line(x["line"], portal, x["key"])))


def articles(pages: DataFrame, portal: Portal, key: str = "page_id", page: str = "html", listed: str = "listed_title") -> DataFrame:
    """One row a page of an old portal: title, body, date, author, publisher, links to documents and the node they are from.

    The body is the blocks of the node before its documents; where that is less than LEAST_BODY words, the lines after the
    title, if they say more. A title that is the institution's name or an entry of the menu gives way to the listed one.
    """
    rows = pages.select(key, text.collapse(F.col(listed)).alias("listed"), portal_page(F.col(page), F.col(listed), portal).alias("p"))
    own = F.when(bad_title(F.col("p.title"), portal) & (F.col("listed") != ""), F.col("listed")).otherwise(F.col("p.title"))
    rows = rows.withColumn("title", F.when(F.col("p.node").isNull(), F.col("listed")).otherwise(own))
    rows = rows.withColumns({"title_key": text.text_key(F.col("title")), "inside": _keyed(F.col("p.inside"), text.text_key), "shown": _keyed(F.col("p.blocks"), text.text_key)})
    open_ = lambda x: (x["line"] != "") & (x["line"] != F.col("title")) & ~crumb(x["line"], x["key"])
    rows = rows.withColumn("open", text.let(F.filter("shown", open_), lambda o: _before(o, _first(o, lambda x: document_heading(x["line"], x["key"])))))
    by = lambda x: author_line(x["line"], portal, x["key"])
    rows = rows.withColumn("author", F.coalesce(F.try_element_at(F.filter("open", by), F.lit(-1))["line"], F.lit("")))
    rows = rows.withColumn("blocks", _bare(F.filter("open", lambda x: ~by(x))))
    inside = lambda ends: body_lines(F.col("inside"), F.col("title_key"), portal, ends)
    rows = rows.withColumn("first", text.clean_body(F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(inside(ENDS))))
    rows = rows.withColumn("second", F.when(text.word_count(F.col("first")) < LEAST_BODY, text.clean_body(inside([*ENDS, *MORE_ENDS]))).otherwise(""))
    rows = rows.withColumn("body", F.when(text.word_count(F.col("second")) > text.word_count(F.col("first")), F.col("second")).otherwise(F.col("first")))
    title_key = F.col("title_key")
    rows = rows.withColumn("place", _first(F.col("inside"), lambda x: F.contains(x["key"], title_key) | (F.contains(title_key, x["key"]) & (x["key"] != ""))))
    place = F.col("place")
    near = F.array_join(F.when(place > 0, F.slice("p.inside", place.cast("int"), F.lit(8))).otherwise(F.slice("p.inside", F.lit(1), F.lit(12))), " ")
    dated = F.concat_ws(" ", "title", "body", "author", near)
    return rows.select(key, "title", "body", text.word_count(F.col("body")).alias("words"), first_of(dated, PORTAL_DATES).alias("date_label"), "author", publisher_of(F.col("author")).alias("publisher"), F.size("p.documents").alias("documents"), F.coalesce("p.node", F.lit("")).alias("node"))
