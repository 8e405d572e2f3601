"""Text functions on columns: normalising, keys, tokens, paragraphs, sentences, redaction. Built-in functions only.

Null counts as empty. Word characters are those of Unicode (``(?U)``), unless said otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Fixed values.
STRICT_STOPWORDS = ["para", "com", "uma", "que", "por", "dos", "das", "estao", "esta", "ser", "sao", "sobre", "entre", "mais", "pela", "pelo", "aos", "nas", "nos"]
BASELINE_STOPWORDS = [*STRICT_STOPWORDS, "informacao", "institucional", "divulgacao", "demanda", "recebida"]
BLOCKED_PARAGRAPHS = ["a+", "a-", "a", "menu", "compartilhe", "ultimas noticias"]
BLOCKED_FRAGMENTS = ["orgaos do governo", "acesso a informacao", "redes sociais", "todos os direitos reservados"]

WORDS_A_MINUTE = 200


def filled(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")


def normalize_space(x: Column) -> Column:
    """No-break spaces and runs of blanks become one space, three line feeds or more become two; stripped."""
    return strip(F.regexp_replace(F.regexp_replace(F.translate(filled(x), " ", " "), r"[ \t\r\f\x0B]+", " "), r"\n{3,}", "\n\n"))


def collapse(x: Column) -> Column:
    """All runs of white space become one space; stripped."""
    return F.trim(F.regexp_replace(filled(x), r"(?U)\s+", " "))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str, str]:
    """Letters up to U+1EFF that decompose into one letter and marks, what they become, and the marks themselves."""
    pairs = []
    for code in range(0xC0, 0x1F00):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code) and unicodedata.category(chr(code)).startswith("L"):
            pairs.append((chr(code), plain))
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), marks


def strip_accents(x: Column) -> Column:
    letters, plain, marks = _accents()
    return F.translate(filled(x), letters + marks, plain)


def text_key(x: Column) -> Column:
    """Without accents and punctuation, lower-case, single spaces."""
    plain = F.regexp_replace(F.lower(strip_accents(normalize_space(x))), r"(?U)[^\w\s]", " ")
    return collapse(plain)


def comparison_key(x: Column) -> Column:
    """ASCII letters and digits only."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(normalize_space(repair_mojibake(x)))), "[^a-z0-9]+", " "))


def repair_mojibake(x: Column) -> Column:
    """Undoes UTF-8 that was read as Latin-1, where the text has its signs and the result is valid."""
    back = F.encode(x, "ISO-8859-1")
    possible = x.rlike("[ÃÂ]") & ~x.rlike("[^\\x00-ÿ]") & F.is_valid_utf8(back.cast("string"))
    return F.when(possible, F.decode(back, "UTF-8")).otherwise(x)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(strip_accents(normalize_space(x))), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def content_tokens(x: Column, stopwords: list[str] = STRICT_STOPWORDS) -> Column:
    """Different tokens of four characters or more that are not stop words."""
    return F.array_distinct(F.filter(tokens(x), lambda t: (F.length(t) >= 4) & ~t.isin(stopwords)))


def word_count(x: Column) -> Column:
    return F.regexp_count(filled(x), F.lit(r"(?U)\b\w+\b")).cast("int")


def text_hash(x: Column) -> Column:
    """SHA-256 of the normalised text; empty for an empty one."""
    n = normalize_space(x)
    return F.when(n == "", "").otherwise(F.sha2(n.cast("binary"), 256))


def blocked_paragraph(x: Column) -> Column:
    key = F.lower(strip_accents(x))
    return key.isin(BLOCKED_PARAGRAPHS) | F.reduce(F.array(*(F.contains(key, F.lit(f)) for f in BLOCKED_FRAGMENTS)), F.lit(False), lambda a, b: a | b)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_body(paragraphs: Column) -> Column:
    """Normalised paragraphs, without empty and blocked ones and without repeats in a row, joined by empty lines."""
    kept = F.filter(F.transform(paragraphs, normalize_space), lambda p: (p != "") & ~blocked_paragraph(p))
    once = let(kept, lambda k: F.filter(F.transform(k, lambda p, i: F.when((i == 0) | (p != F.get(k, F.greatest(i - 1, F.lit(0)))), p)), lambda p: p.isNotNull()))
    return F.array_join(once, "\n\n")


def lead(paragraphs: Column) -> Column:
    """First paragraph of five words or more."""
    return F.coalesce(F.get(F.filter(F.transform(paragraphs, normalize_space), lambda p: F.size(F.split(p, r"\s+")) >= 5), F.lit(0)), F.lit(""))


def reading_time(words: Column) -> Column:
    return F.when(words <= 0, 0).otherwise(F.greatest(F.lit(1), F.bround(words / WORDS_A_MINUTE, 0).cast("int"))).cast("int")


def sentences(x: Column) -> Column:
    return F.filter(F.split(collapse(x), r"(?<=[.!?])\s+"), lambda s: s != "")


def first_sentence(x: Column, longest: int = 240) -> Column:
    """Up to the first of ``. ``, ``! `` and ``? ``, tried in this order; else the first characters."""
    t = collapse(x)
    found = F.lit(None).cast("string")
    for mark in (". ", "! ", "? "):
        found = F.coalesce(found, F.when(F.instr(t, mark) > 0, F.concat(F.substring_index(t, mark, 1), F.lit(mark[0]))))
    return F.coalesce(found, F.left(t, F.lit(longest)))


def scrub_query(x: Column) -> Column:
    """Without dates, four-digit numbers, brackets and addresses; 600 characters at most."""
    t = normalize_space(x)
    for pattern in (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{4}\b", r"\([^)]*\)", r"https?://\S+"):
        t = F.regexp_replace(t, pattern, "")
    return F.left(collapse(t), F.lit(600))


def _quoted(v: Column) -> Column:
    return F.concat(F.lit("(?iu)"), F.regexp_replace(v, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))


def redact(x: Column, values: Column, by: str, least: int = 1) -> Column:
    """Each of the values of ``least`` characters or more, longest first, replaced whatever its case."""
    ordered = F.reverse(F.array_sort(F.transform(F.filter(F.array_distinct(values), lambda v: F.length(v) >= least), lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))))
    return F.reduce(ordered, filled(x), lambda text, v: F.regexp_replace(text, _quoted(v["v"]), F.lit(by)))


def redact_fields(x: Column, values: Column, by: str = "[FIELD REMOVED]") -> Column:
    """Listed values, addresses and dates."""
    t = redact(x, values, by, 4)
    for pattern in (r"https?://\S+", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"):
        t = F.regexp_replace(t, pattern, by)
    return t


def title_suffix(x: Column, site: str) -> Column:
    """Without a trailing ``- <site> ...``."""
    return F.trim(F.regexp_replace(filled(x), r"(?i)\s+[-|]\s+" + re.escape(site) + r".*$", ""))


def generic_title(key: Column, phrases: list[str]) -> Column:
    """A title key of three words or fewer, or one of the given phrases."""
    return (F.size(F.split(key, " ")) <= 3) | key.isin(phrases)


def fingerprint(x: Column) -> Column:
    return F.sha2(collapse(x).cast("binary"), 256)


def preview(x: Column, longest: int = 500) -> Column:
    return F.left(F.translate(filled(x), "\n", " "), F.lit(longest))


def model_text(*parts: Column) -> Column:
    return normalize_space(F.concat_ws("\n", *(F.when(filled(p) != "", p) for p in parts)))


def sentence_with(x: Column, keywords: list[str]) -> Column:
    """First sentence that holds one of the keywords, or empty."""
    pattern = "(?i)" + "|".join(map(re.escape, keywords))
    return F.coalesce(F.get(F.filter(sentences(x), lambda s: s.rlike(pattern)), F.lit(0)), F.lit(""))


def markdown_cell(x: Column) -> Column:
    return F.translate(F.replace(filled(x), F.lit("|"), F.lit("/")), "\n", " ")


# Fixed values.
_FOLD_FROM, _FOLD_TO = "áàâãäéêèíìóôõöúüç", "aaaaaeeeiioooouuc"


def fold_letters(x: Column) -> Column:
    """Seventeen accented letters as plain ones, in either case; all others stay."""
    return F.translate(x, _FOLD_FROM + _FOLD_FROM.upper(), _FOLD_TO + _FOLD_TO.upper())


def context_text(*columns: str) -> Column:
    """Columns joined by blanks; null counts as empty."""
    return F.concat_ws(" ", *(filled(F.col(c)) for c in columns))


def publisher(x: Column) -> Column:
    """What follows "Publicado por:" up to a slash."""
    return normalize_space(F.regexp_extract(normalize_space(x), r"(?i)publicado por:\s*([^/]+)", 1))
