"""URL functions on columns. Built-in functions only. Null counts as empty."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import filled, text_key

# Fixed values.
STATIC_EXTENSIONS = ["7z", "bmp", "css", "csv", "doc", "docx", "gif", "ico", "jpeg", "jpg", "js", "json", "mp3", "mp4", "pdf", "png", "ppt", "pptx", "rar", "svg", "webp", "xls", "xlsx", "xml", "zip"]
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]
DOCUMENT_EXTENSIONS = ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "zip", "rar"]
VIDEO_HOSTS = ["youtube.com", "youtu.be", "vimeo.com"]
MEETING_HOSTS = ["meet.google.com", "zoom.us", "teams.microsoft.com"]
FORM_MARKS = ["forms.gle", "docs.google.com/forms", "forms.office.com"]
DRIVE_MARKS = ["drive.google.com", "docs.google.com"]

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query."""
    return F.regexp_extract(F.trim(filled(url)), _PARTS, group)


def host(url: Column) -> Column:
    """Lower-case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return part(url, 3)


def normalize_path(p: Column) -> Column:
    """One leading slash, no empty segments, no dots; a trailing slash stays."""
    p = F.regexp_replace(p, ";[^/]*$", "")
    segments = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    folded = F.reduce(segments, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"))
    return F.when(F.endswith(p, F.lit("/")) & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no user, fragment or tracking parameters, a tidy path."""
    port = F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    authority = F.when(port == "", host(url)).otherwise(F.concat(host(url), F.lit(":"), port))
    items = F.filter(F.split(part(url, 4), "&"), lambda x: (x != "") & ~(F.startswith(F.lower(x), F.lit("utm_")) | F.lower(F.substring_index(x, "=", 1)).isin(TRACKING)))
    query = F.array_join(F.transform(items, lambda x: F.when(F.contains(x, F.lit("=")), x).otherwise(F.concat(x, F.lit("=")))), "&")
    scheme = F.lower(part(url, 1))
    head = F.concat(F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))), F.when(authority == "", "").otherwise(F.concat(F.lit("//"), authority)))
    return F.concat(head, normalize_path(path(url)), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def static_extension(url: Column) -> Column:
    return F.lower(path(url)).rlike(r"\.(" + "|".join(STATIC_EXTENSIONS) + ")$")


def relative(href: Column) -> Column:
    h = F.trim(filled(href))
    return F.startswith(h, F.lit("/")) | ((h != "") & (part(h, 1) == "") & ~F.startswith(h, F.lit("#")))


def resolvable(href: Column) -> Column:
    """Not empty, a fragment, or a mail, telephone or script address."""
    h = F.trim(filled(href))
    return (h != "") & ~F.startswith(h, F.lit("#")) & ~F.lower(h).rlike("^(mailto|tel|javascript):")


def resolve(href: Column, base: Column) -> Column:
    """An absolute address of a link on a page, null if it leads nowhere."""
    h = F.regexp_replace(F.trim(filled(href)), "#.*$", "")
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_extract(path(base), "^(.*/)", 1)
    full = (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(part(base, 1), F.lit(":"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(root, h))
        .when(F.startswith(h, F.lit("?")), F.concat(root, path(base), h))
        .otherwise(F.concat(root, normalize_path(F.concat(folder, h))))
    )
    return F.when(resolvable(href) & full.rlike("^(?i)https?://[^/?#]+"), full)


def slug(url: Column) -> Column:
    return F.coalesce(F.element_at(F.split(F.regexp_replace(path(url), "^/+|/+$", ""), "/"), -1), F.lit(""))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"(\.[^./]+)$", 1))


def host_is(url: Column, domain: str) -> Column:
    """The host is the domain or below it."""
    return (host(url) == domain) | F.endswith(host(url), F.lit("." + domain))


def path_template(url: Column) -> Column:
    """The path with numbers as {id} and a last slug of several words as {slug}."""
    p = F.regexp_replace(path(url), r"/\d+(?=/|$)", "/{id}")
    p = F.regexp_replace(p, r"/\d+(\.[a-z]+)$", "/{id}$1")
    return F.regexp_replace(p, r"/[a-z0-9]+(?:-[a-z0-9]+){2,}(?=/?$)", "/{slug}")


def link_type(url: Column, anchor: Column, own_domain: str) -> Column:
    """First of form, drive, document, video, meeting, edital, internal, external that fits."""
    low, words = F.lower(filled(url)), text_key(anchor)
    has = lambda marks: low.rlike("|".join(map(re.escape, marks)))
    return (
        F.when(has(FORM_MARKS), "form").when(has(DRIVE_MARKS), "drive")
        .when(extension(url).isin(["." + e for e in DOCUMENT_EXTENSIONS]), "document")
        .when(has(VIDEO_HOSTS), "video").when(has(MEETING_HOSTS), "meeting")
        .when(F.contains(low, F.lit("edital")) | words.rlike(r"\beditais?\b|\bedital\b"), "edital")
        .when(host_is(url, own_domain) | relative(url), "internal").otherwise("external")
    )


def attachment(kind: Column) -> Column:
    return kind.isin("document", "edital", "drive")


def pagination_pattern(url: Column) -> Column:
    """query_page, query_pagina, path_page, path_pagina, or null."""
    return (
        F.when(url.rlike(r"[?&]page=\d+"), "query_page").when(url.rlike(r"[?&]pagina=\d+"), "query_pagina")
        .when(url.rlike(r"/page/\d+"), "path_page").when(url.rlike(r"/pagina/\d+"), "path_pagina")
    )
