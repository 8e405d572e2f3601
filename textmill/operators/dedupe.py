"""Exact and fuzzy duplicates: edges by shared keys and by blocked similarity, groups, canonical choice, consolidation."""

from __future__ import annotations

from collections import Counter
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType

from ..functions import text
from ..sources.scratch import stage
from .graph import components

TITLE_LEAST, BODY_LEAST = 95, 90
LARGEST_BLOCK = 350
CELL = 512
#: Bodies of one block that meet in a task: BODY_CELL with BODY_CELL others at most.
BODY_CELL = 256


def exact_edges(df: DataFrame, key_of: dict[str, tuple[Column, float]], node: str = "doc_id") -> DataFrame:
    """(src, dst, reason, confidence) from the smallest node of each non-empty key to the others, for each key family.

    The smallest node is aggregated and joined back, so a key that many rows share is not collected in one task.
    """
    found = None
    for reason, (key, confidence) in key_of.items():
        keyed = df.select(F.col(node).alias("dst"), key.alias("key")).where("key <> ''")
        first = keyed.groupBy("key").agg(F.min("dst").alias("src"), F.count("*").alias("n")).where("n > 1")
        edges = keyed.join(first, "key").where("src <> dst").select("src", "dst", F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))
        found = edges if found is None else found.union(edges)
    return found


def blocked_pairs(df: DataFrame, keys: Column, node: str = "doc_id", largest: int | None = None, single: bool = False) -> DataFrame:
    """Different pairs (a, b), a < b, of rows that share one of an array of block keys.

    Large blocks are dealt into cells of about CELL rows, and each two cells meet in a task of their own. Only with
    ``largest`` are blocks above it left out; see :func:`oversized_blocks`. ``single`` says that each node is in one row
    of one key, so no pair is met twice and pairs are not shuffled.
    """
    keyed = df.select(F.col(node).alias("node"), F.explode(F.array_distinct(keys)).alias("block")).where("block <> ''")
    sizes = keyed.groupBy("block").agg(F.count("*").alias("n")).where("n > 1" if largest is None else f"n between 2 and {largest}")
    cells = F.ceil(F.col("n") / CELL).cast("int")
    placed = keyed.join(sizes, "block").select("node", "block", cells.alias("cells"), F.pmod(F.xxhash64("node"), cells).cast("int").alias("own"))
    low = placed.select("block", F.col("own").alias("low"), F.explode(F.sequence("own", F.col("cells") - 1)).alias("high"), F.col("node").alias("x"))
    high = placed.select("block", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("low"), F.col("own").alias("high"), F.col("node").alias("y"))
    met = low.join(high, ["block", "low", "high"]).where("x < y or low < high and x <> y")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs if single else pairs.distinct()


def oversized_blocks(df: DataFrame, keys: Column, largest: int = LARGEST_BLOCK) -> DataFrame:
    """The blocks that :func:`blocked_pairs` leaves out with the same ``largest``, with their sizes."""
    return df.select(F.explode(F.array_distinct(keys)).alias("block")).where("block <> ''").groupBy("block").agg(F.count("*").alias("n")).where(f"n > {largest}")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    return subsequence_of(places(a), len(a), b)


def places(a: str) -> dict[str, int]:
    """Where each character stands, as bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    return where


def subsequence_of(where: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of b and a text of n characters with these :func:`places`."""
    row = full = (1 << n) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return n - row.bit_count()


def indel(a: str | None, b: str | None) -> int:
    """Similarity 0 to 100: twice the common subsequence over both lengths, rounded."""
    a, b = a or "", b or ""
    return 100 if not a and not b else round(200 * common_subsequence(a, b) / (len(a) + len(b)))


@F.pandas_udf(IntegerType())
def indel_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(x, y) for x, y in zip(a, b)], dtype="int32")


def indel_from(a: str, b: str, least: int) -> int:
    """:func:`indel` where that is ``least`` or more, else 0: whole texts, but most unlike ones end at their letter counts."""
    total = len(a) + len(b)
    if a == b or not total:
        return 100
    top = min(len(a), len(b))
    head = len(commonprefix((a, b)))
    tail = len(commonprefix((a[head:][::-1], b[head:][::-1])))
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]  # ends in common are in a longest common subsequence
    if round(200 * top / total) < least or round(200 * (head + tail + (Counter(a) & Counter(b)).total()) / total) < least:
        return 0
    score = round(200 * (head + tail + common_subsequence(a, b)) / total)
    return score if score >= least else 0


@F.pandas_udf(IntegerType())
def body_indel_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_from(x or "", y or "", BODY_LEAST) for x, y in zip(a, b)], dtype="int32")


def profile_of(body: str) -> np.ndarray:
    """How often letters (256 buckets) and pairs of neighbouring letters (1,024 buckets) stand in a text."""
    codes = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
    pairs = (codes[:-1] * np.uint32(2654435761) + codes[1:]) % 1024
    return np.concatenate([np.bincount(codes % 256, minlength=256), np.bincount(pairs, minlength=1024)]).astype(np.int32)


def highest(a: np.ndarray, b: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """For rows of profiles, scores that :func:`indel` does not exceed: an insertion or deletion changes one letter and three pairs at most."""
    change = np.abs(a - b)
    least = np.maximum(change[:, :256].sum(1), -(-change[:, 256:].sum(1) // 3))
    return np.rint(200 * ((totals - least) // 2) / np.maximum(totals, 1)).astype(np.int64)


def linked_bodies(pairs: list[tuple[int, int, bool, int]], bodies: dict[int, str]) -> list[tuple[int, int, bool, int]]:
    """Of pairs (a, b, alike, title_score) enough with alike bodies to connect what all of those connect, with their scores.

    Pairs with alike titles and others are connected apart, so each kind has links wherever all pairs have it, and of each
    the highest score: the title's, else the body's. Pairs that are connected already are compared only where they
    may exceed that, the most promising first.
    """
    place = {node: i for i, node in enumerate(bodies)}
    texts = list(bodies.values())
    profiles = np.stack([profile_of(t) for t in texts])
    sizes = np.array([len(t) for t in texts])
    by_first: dict[int, list[int]] = {}
    for k, pair in enumerate(pairs):
        by_first.setdefault(place[pair[0]], []).append(k)
    most = np.zeros(len(pairs), np.int64)
    for i, held in by_first.items():
        others = np.array([place[pairs[k][1]] for k in held])
        most[held] = np.where(sizes[i] + sizes[others] > 0, highest(profiles[others], profiles[i][None], sizes[i] + sizes[others]), 100)
    found = []
    for kind in (True, False):
        up: dict[int, int] = {}
        best: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        ranked = sorted((k for k in range(len(pairs)) if pairs[k][2] == kind and most[k] >= BODY_LEAST), key=lambda k: (-pairs[k][3] if kind else 0, -most[k]))
        for k in ranked:
            a, b, _, title_score = pairs[k]
            x, y = root(a), root(b)
            least = BODY_LEAST if x != y else 101 if kind else best[x] + 1
            if most[k] < least or not (score := indel_from(bodies[a], bodies[b], least)):
                continue
            if not kind:
                best[x] = max(best.get(x, 0), best.get(y, 0), score)
            up[y] = x
            found.append((a, b, kind, title_score if kind else score))
    return found


LINK = "a long, b long, alike boolean, score int"


def body_links(met: DataFrame, bodies: DataFrame) -> DataFrame:
    """(a, b, alike, score): :func:`linked_bodies` of ``met`` (a, b, alike, title_score, block) with ``bodies`` (node, body).

    The nodes of a block are dealt into cells of about BODY_CELL, and each two cells meet in a task of their own, which
    has each body once however many pairs it is in.
    """
    sizes = met.select("block", F.explode(F.array("a", "b")).alias("node")).distinct().groupBy("block").agg(F.ceil(F.count("*") / BODY_CELL).alias("cells"))
    cell = lambda s: F.pmod(F.xxhash64(s), F.col("cells"))
    at = ["block", "low", "high"]
    dealt = stage(met.join(sizes, "block").select("block", F.least(cell("a"), cell("b")).alias("low"), F.greatest(cell("a"), cell("b")).alias("high"), "a", "b", "alike", "title_score"), "dealt")
    needed = dealt.select(*at, F.explode(F.array("a", "b")).alias("node")).distinct()
    there = stage(bodies.join(needed.select("node").distinct(), "node", "left_semi").select("node", "body"), "texts")
    beside = needed.join(there, "node").select(*(F.col(c).alias(f"{c}_") for c in at), "node", "body")

    def linked(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        rows = list(zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "alike", "title_score"))))
        found = linked_bodies(rows, dict(zip(texts.column("node").to_pylist(), (t or "" for t in texts.column("body").to_pylist())))) if rows else []
        columns = list(zip(*found)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int32()))], ["a", "b", "alike", "score"])

    return dealt.groupBy(at).cogroup(beside.groupBy([f"{c}_" for c in at])).applyInArrow(linked, LINK)


def may_reach(a: Column, b: Column, least: int) -> Column:
    """False only where the rounded indel similarity cannot be ``least``: a native test before the UDF."""
    most = F.floor((1 - (least - 0.5) / 100) * (F.length(a) + F.length(b))).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= most)


def lengths_fit(a: Column, b: Column) -> Column:
    """False only where bodies of these lengths cannot be alike."""
    return F.abs(a - b) <= (1 - (BODY_LEAST - 0.5) / 100) * (a + b)


def scored_titles(both: DataFrame) -> DataFrame:
    """With ``title_score`` of a_title and b_title, 0 where it cannot be TITLE_LEAST."""
    near = may_reach(F.col("a_title"), F.col("b_title"), TITLE_LEAST)
    return both.withColumn("title_score", F.when(near, indel_score(F.when(near, F.col("a_title")), F.when(near, F.col("b_title")))).otherwise(0))


def scored_bodies(both: DataFrame) -> DataFrame:
    """The pairs whose bodies are alike, with ``body_score``."""
    return both.withColumn("body_score", body_indel_score("a_body", "b_body")).where(F.col("body_score") >= BODY_LEAST)


def fuzzy_edges(pairs: DataFrame, rows: DataFrame, title: str, body: str, dedupable: str, safe: Column | None = None, node: str = "doc_id") -> DataFrame:
    """Edges for pairs (a, b) with alike titles, or else alike bodies, whole and normalised, if both are dedupable.

    ``safe`` is a condition on (a_title, b_title, same_date) for titles that prove nothing on their own.
    """
    side = lambda s: rows.select(F.col(node).alias(s), F.col(title).alias(f"{s}_title"), text.normalize_space(F.col(body)).alias(f"{s}_body"), F.col(dedupable).alias(f"{s}_ok"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    scored = scored_titles(both)
    by_title = (F.col("title_score") >= TITLE_LEAST) & (F.lit(True) if safe is None else safe)
    titled = scored.where(by_title).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("title_similarity").alias("reason"), (F.col("title_score") / 100).alias("confidence"))
    bodied = scored_bodies(scored.where(~by_title & F.col("a_ok") & F.col("b_ok")).where(lengths_fit(F.length("a_body"), F.length("b_body"))))
    return titled.union(bodied.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("body_similarity").alias("reason"), (F.col("body_score") / 100).alias("confidence")))


def title_pairs(rows: DataFrame, keys: Column, title: str, node: str = "doc_id", entity: str | None = None) -> DataFrame:
    """(a, b, a_title, b_title, a_rows, b_rows): pairs of different titles with a block in common, each as its smallest row.

    A title has the blocks of all its rows. How often a title stands does not matter to the number of pairs. With
    ``entity``, values of this column take the place of titles, and those of one entity have one title.
    """
    of = F.col(entity or title).alias("entity")
    titles = stage(rows.groupBy(of).agg(F.min(F.col(title)).alias("title"), F.min(node).alias("first"), F.count("*").alias("rows")), "titles")
    blocks = rows.select(of, F.explode(keys).alias("block")).distinct().join(titles, "entity").select("first", F.array("block").alias("keys"))
    side = lambda s: titles.select(F.col("first").alias(s), F.col("title").alias(f"{s}_title"), F.col("rows").alias(f"{s}_rows"))
    return blocked_pairs(blocks, F.col("keys"), "first").join(side("a"), "a").join(side("b"), "b")


#: Titles that prove nothing on their own, besides those of three words or fewer: fixed values.
GENERIC_TITLES = ["nota de falecimento", "pregao eletronico", "resultado final", "retificacao", "comunicado"]


def near_edges(rows: DataFrame, keys: Column, title: str, body: str, dedupable: str, date: str | None = None, node: str = "doc_id") -> DataFrame:
    """Edges that connect what alike titles or alike bodies connect over all pairs of rows that share a block, whatever its size.

    With ``date``, alike titles of which one is generic count only between rows of the same date or with alike bodies.

    Rows with one title (and, where it is generic, one date, or one body where there is no date) are linked to the
    smallest of them, and compared with others once, as titles of the smallest rows. Bodies are compared between those
    that titles alone do not link: once for each title, date and body, where rows share a block, and only as far as
    links do not connect them yet. The groups, their reasons and highest confidences are those of all pairs.
    """
    normal = text.normalize_space(F.col(body))
    generic = text.generic_title(F.col(title), GENERIC_TITLES) if date else F.lit(False)
    day = F.coalesce(F.col(date).cast("string"), F.lit("")) if date else F.lit("")
    same = F.md5(normal.cast("binary"))
    entity = F.when(~generic, F.col(title)).otherwise(F.concat_ws("\u0000", title, day, F.when(day == "", same)))
    held = rows.where(F.col(title) != "").select(F.col(node).alias("node"), F.col(title).alias("title"), entity.alias("entity"), generic.alias("generic"), day.alias("day"), same.alias("same"), F.length(normal).alias("n"), F.col(dedupable).alias("ok"), F.array_distinct(keys).alias("keys"))
    titled = stage(held, "titled")
    first = stage(titled.groupBy("entity").agg(F.min("node").alias("first"), F.first("generic").alias("generic"), F.min("day").alias("day")), "entities")
    edges = titled.select("entity", "node").join(first, "entity").where("node <> first").select(F.col("first").alias("src"), F.col("node").alias("dst"), F.lit("title_similarity").alias("reason"), F.lit(1.0).alias("confidence"))
    side = lambda s: first.select(F.col("first").alias(s), F.col("entity").alias(f"{s}_entity"), F.col("generic").alias(f"{s}_generic"), F.col("day").alias(f"{s}_day"))
    pairs = scored_titles(title_pairs(titled, F.col("keys"), "title", "node", "entity")).join(side("a"), "a").join(side("b"), "b")
    safe = ~(F.col("a_generic") | F.col("b_generic")) | ((F.col("a_day") == F.col("b_day")) & (F.col("a_day") != ""))
    scored = stage(pairs.withColumns({"alike": F.col("title_score") >= TITLE_LEAST, "linked": (F.col("title_score") >= TITLE_LEAST) & safe}), "scored")
    edges = edges.union(scored.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("title_similarity").alias("reason"), (F.col("title_score") / 100).alias("confidence")))
    apart = scored.where("not linked").select("a_entity", "b_entity", "alike", "title_score")
    # of titles that are alike but not linked all rows count, of others those that are dedupable
    doubtful = scored.where("alike and not linked").select(F.explode(F.array("a_entity", "b_entity")).alias("entity")).distinct().withColumn("doubtful", F.lit(True))
    counting = titled.join(doubtful, "entity", "left").where("ok or doubtful")
    kinds = stage(counting.groupBy("entity", "same", "n", "ok").agg(F.min("node").alias("node"), F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys")), "bodies")
    member = lambda s: kinds.select(F.col("entity").alias(f"{s}_entity"), F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("ok").alias(f"{s}_ok"), F.col("keys").alias(f"{s}_keys"))
    compared = F.col("alike") | (F.col("a_ok") & F.col("b_ok"))
    block = F.get(F.filter(F.array_intersect("a_keys", "b_keys"), lambda k: k.isNotNull()), F.lit(0))
    met = apart.join(member("a"), "a_entity").join(member("b"), "b_entity").where(compared & lengths_fit(F.col("a_n"), F.col("b_n"))).withColumn("block", block).where("block is not null").select("a", "b", "alike", "title_score", "block")
    bodied = body_links(stage(met, "met"), rows.select(F.col(node).alias("node"), normal.alias("body")))
    reason = F.when(F.col("alike"), "title_similarity").otherwise("body_similarity")
    return edges.union(bodied.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), reason.alias("reason"), (F.col("score") / 100).alias("confidence")))


def assign_groups(rows: DataFrame, edges: DataFrame, better: list[Column], node: str = "doc_id") -> DataFrame:
    """``rows`` with group_root (own node if alone), group_size and is_canonical: the best of each group by ``better``, then the smallest node."""
    roots = components(edges).select(F.col("node").alias(node), F.col("root"))
    grouped = rows.join(roots, node, "left").withColumn("group_root", F.coalesce("root", F.col(node))).drop("root")
    best = F.struct(*better, (-F.col(node)).alias("first"))
    chosen = grouped.groupBy("group_root").agg(F.count("*").alias("group_size"), F.max_by(F.col(node), best).alias("canonical"))
    return grouped.join(chosen, "group_root").withColumn("is_canonical", F.col(node) == F.col("canonical"))


def group_table(grouped: DataFrame, edges: DataFrame, node: str = "doc_id") -> DataFrame:
    """One row for each group of two or more: numbered by first member, with canonical, size, confidence, reasons and members."""
    of = grouped.select(F.col(node).alias("dst"), "group_root")
    why = edges.join(of, "dst").groupBy("group_root").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    members = grouped.where("group_size > 1").groupBy("group_root").agg(F.first("canonical").alias("canonical"), F.count("*").alias("size"), F.min(node).alias("first"), F.array_sort(F.collect_set("environment")).alias("environments"), F.array_sort(F.collect_list(node)).alias("members"))
    number = F.format_string("dup_%08d", F.row_number().over(Window.orderBy("first")))
    return members.join(why, "group_root").withColumn("group_id", number).select("group_id", "canonical", "size", "confidence", "reasons", "environments", "members", (F.size("environments") > 1).alias("cross_source"))


def consolidate(parts: dict[str, DataFrame], order: str, prefix: str = "gart") -> DataFrame:
    """Union of data sets with provenance: dataset, original id and a new global id."""
    from .sampling import numbered

    united = None
    for name, df in parts.items():
        one = df.withColumn("dataset", F.lit(name)).withColumn("original_id", F.col(order))
        united = one if united is None else united.unionByName(one, allowMissingColumns=True)
    return numbered(united, prefix, ["dataset", order], "global_id")


def near_keys(keys: DataFrame, key: str, percent: int = 5) -> DataFrame:
    """(a, b, distance): all pairs of different keys, a < b, whose edit distance is at most ``percent`` of the longer one.

    No block and no cross join: of a key cut into one segment more than edits are allowed, one segment is untouched, and
    stands in the other key about where it was. So keys meet by (length, edits allowed, segment number, segment).
    """
    once = stage(keys.select(F.col(key).alias("t"), F.length(key).alias("n")).where("n > 0").distinct().withColumn("id", F.monotonically_increasing_id()), "near-keys")
    met = segments_met(once, percent)
    side = lambda s: once.select(F.col("id").alias(f"{s}_id"), F.col("t").alias(s))
    both = met.join(side("x"), "x_id").join(side("y"), "y_id").withColumn("distance", F.levenshtein("x", "y")).where("distance <= k")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def segments_met(texts: DataFrame, percent: int) -> DataFrame:
    """Different (x_id, y_id, k) of texts (id, t, n) that share a segment; only numbers are shuffled.

    Of k + 1 segments and k edits at most there is an untouched one, say number i from 0, with exactly i edits before it:
    so it stands i places off at most, and, counted from the ends of both texts, k - i at most.
    """
    allowed = lambda n: F.floor(n * percent / 100).cast("int")
    edge = lambda i, n, k: F.floor(i * n / (k + 1)).cast("int")
    meet = lambda n, k, i, s: F.xxhash64(n, k, i, s)
    longest = F.floor(F.col("n") * 100 / (100 - percent)).cast("int")
    held = texts.withColumn("k", F.explode(F.sequence(allowed(F.col("n")), allowed(longest)))).where("k > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    start, stop = edge(F.col("i"), F.col("n"), F.col("k")), edge(F.col("i") + 1, F.col("n"), F.col("k"))
    held = held.select(F.col("id").alias("x_id"), meet(F.col("n"), F.col("k"), F.col("i"), F.substr("t", start + 1, stop - start)).alias("meet"))
    asked = texts.withColumn("k", allowed(F.col("n"))).where("k > 0").withColumn("m", F.explode(F.sequence(F.col("n") - F.col("k"), F.col("n")))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    asked = asked.withColumn("start", edge(F.col("i"), F.col("m"), F.col("k"))).withColumn("size", edge(F.col("i") + 1, F.col("m"), F.col("k")) - F.col("start"))
    more, after = F.col("n") - F.col("m"), F.col("k") - F.col("i")
    first, last = F.greatest(F.col("start") - F.col("i"), F.col("start") + more - after, F.lit(0)), F.least(F.col("start") + F.col("i"), F.col("start") + more + after, F.col("n") - F.col("size"))
    asked = asked.withColumn("at", F.explode(F.when(first <= last, F.sequence(first, last))))
    asked = asked.select(F.col("id").alias("y_id"), "k", meet(F.col("m"), F.col("k"), F.col("i"), F.substr("t", F.col("at") + 1, F.col("size"))).alias("meet"))
    # of two texts of one length each asks for the other: one of the two is enough
    return held.join(asked, "meet").where("x_id <> y_id").groupBy(F.least("x_id", "y_id").alias("x_id"), F.greatest("x_id", "y_id").alias("y_id")).agg(F.max("k").alias("k"))
