"""Rules about news links. Built-in functions only; hosts of the own institution are parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import urls
from .text import filled

# Fixed values.
TAXONOMY = ["/categoria/", "/category/", "/tag/", "/author/", "/feed/", "/wp-content/", "/wp-json/"]
OVERVIEWS = ["/", "/blog/", "/conteudo/noticias/", "/noticias/"]


def closed_path(url: Column) -> Column:
    """The path with exactly one slash at its end."""
    return F.concat(F.regexp_replace(urls.path(url), "/+$", ""), F.lit("/"))


def taxonomy(path: Column) -> Column:
    """Archives, feeds and overviews, by the closed lower-case path."""
    return path.rlike("|".join(TAXONOMY)) | path.isin(OVERVIEWS)


def article_slug(path: Column) -> Column:
    """The last segment has eight characters or more, is no number, and has a hyphen or a folder before it."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return (F.length(last) >= 8) & ~last.rlike(r"^\d+$") & (F.contains(last, F.lit("-")) | (F.size(parts) >= 2))


def news_kind(url: Column, label: Column, in_navigation: Column, in_article: Column, own_domain: str, legacy_host: str) -> Column:
    """legacy_article, current_wordpress_article, article_like_path, article_context, or null for what is no news link."""
    path = F.lower(closed_path(url))
    own = (urls.host(url) == legacy_host) | urls.host_is(url, own_domain)
    out = urls.static_extension(url) | ~own | taxonomy(path) | in_navigation
    return (
        F.when(out, None).when(path.rlike("^/conteudo/noticia/[^/]+/$"), "legacy_article").when(path.rlike("^/blog/[^/]+/$"), "current_wordpress_article")
        .when(path.rlike("/conteudo/noticia/[^/]+/"), "legacy_article").when(path.rlike("/noticias?/[^/]+/"), "article_like_path")
        .when(in_article & (F.length(filled(label)) >= 18) & article_slug(path), "article_context")
    )


def old_portal_kind(url: Column) -> Column:
    """How an address of the old portal is built; empty if in no known way."""
    path = closed_path(url)
    return F.when(path.rlike(r"^/noticias/\d+/$"), "numeric_news").when(F.lower(path).rlike("^/noticias/[a-z0-9-]+/$"), "slug_news").when(F.lower(path).rlike("/noticias?/[^/]+/"), "article_like").otherwise("")


def accepted(url: Column, source: Column, kind: Column, base: Column, legacy_host: str, main_host: str) -> Column:
    """Whether a source takes a candidate: by its id for the legacy and the current portal, else by its kind."""
    path, host = closed_path(url), urls.host(url)
    return (
        F.when(source == "legacy", (host == legacy_host) & F.startswith(path, F.lit("/conteudo/noticia/"))).when(source == "current", (host == main_host) & F.startswith(path, F.lit("/blog/")))
        .when(kind == "campus_wordpress", host == urls.host(base)).when(kind == "old_subdomain_portal", (host == urls.host(base)) & F.lower(path).rlike("^/noticias/[^/]+/$")).otherwise(True)
    )


def link_base(request: Column, final: Column, legacy_host: str) -> Column:
    """Links resolve against the final address, but a page asked from the legacy host stays there."""
    stays = (urls.host(request) == legacy_host) & (urls.host(final) != legacy_host)
    return F.when(stays, request).otherwise(F.coalesce(F.nullif(final, F.lit("")), request))


def candidate_quality(*fields: Column) -> Column:
    """How many of the fields are filled."""
    return sum((F.when(filled(f) != "", 1).otherwise(0) for f in fields), F.lit(0))
