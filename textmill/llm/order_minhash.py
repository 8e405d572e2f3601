"""Order MinHash fingerprints. Built-in functions only.

The k-mers of a text are its runs of K tokens, numbered by occurrence: a later occurrence of a k-mer is an element of
its own. Tokens are parted by white space, and those of more than LONG code points are taken apart into single code
points, so that texts that write no blanks have k-mers too. Elements are hashed onto a circle. From each of SLOTS fixed points on, the two elements
that follow are selected, put back into text order and hashed as a pair, so that signatures agree only where the
same elements come in the same order. One sort serves all slots, and a text with few elements simply selects the
same ones for several slots.

An element is one long: 40 bits of hash above 24 bits of position. Positions from 2^24 - 1 on count as that one.

Defined results: a null text counts as empty, and an empty text has one k-mer; texts with fewer than K tokens are
one k-mer; equal texts have equal fingerprints; equal ids follow each other by a hash of their texts, null ids come
last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

K, SLOTS, BITS, LONG = 3, 64, 24, 24
LAST = (1 << BITS) - 1
#: Rows that neighbours are looked up among; the ends of these buckets are joined to the next one.
BUCKET_ROWS = 2048
FEW_HEADS = 20_000
#: Ranges of about as many ids each that buckets are cut from.
RANGES = 256
_NULL_PLACE = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _top(x: Column) -> Column:
    return F.shiftright(x, BITS)


def _elements(tokens: Column) -> Column:
    """Sorted elements of a list of tokens, without repeated hashes."""

    def kmer(w: Column, i: Column) -> Column:
        hashed = F.xxhash64(*(F.get(w, i + k) for k in range(K)))
        return hashed.bitwiseAND(F.lit(~LAST)).bitwiseOR(F.least(i, F.lit(LAST - 1)).cast("long"))

    def numbered(s: Column, n: Column) -> Column:
        """First occurrences keep their hash; the others are hashed with their number."""
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (_top(F.get(s, i)) != _top(F.get(s, F.greatest(i - 1, F.lit(0))))))

        def split(st: Column) -> Column:
            first = F.transform(st, lambda a: F.get(s, a))
            runs = F.filter(F.transform(st, lambda a, j: F.struct(a.alias("a"), F.coalesce(F.get(st, j + 1), n).alias("b"))), lambda r: r["b"] > r["a"] + 1)
            again = F.transform(runs, lambda r: F.transform(F.sequence(r["a"] + 1, r["b"] - 1), lambda i: F.xxhash64(_top(F.get(s, i)), i - r["a"]).bitwiseAND(F.lit(~LAST)).bitwiseOR(F.get(s, i).bitwiseAND(F.lit(LAST)))))
            return F.when(F.size(st) == n, s).otherwise(F.concat(first, F.flatten(again)))

        return let(starts, split)

    made = let(tokens, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - K, F.lit(0))), lambda i: kmer(w, i)))
    return let(F.sort_array(made), lambda s: numbered(s, F.size(s)))


def tokens(text: Column) -> Column:
    blank = "\\x20\\x09-\\x0D"
    words = F.split(text, f"[{blank}]+")
    apart = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG, F.split(w, "")).otherwise(F.array(w))))
    return F.when(text.rlike(f"[^{blank}]{{{LONG + 1}}}"), apart).otherwise(words)


def signature(text: Column) -> Column:
    """SLOTS values of 16 bits, as array<smallint>."""
    step = 1 << 64 - (SLOTS.bit_length() - 1)
    marks = F.array(*(F.lit((-(1 << 63) + j * step) | LAST) for j in range(SLOTS)))

    def pair(x: Column, y: Column) -> Column:
        in_order = x.bitwiseAND(F.lit(LAST)) <= y.bitwiseAND(F.lit(LAST))
        return F.xxhash64(_top(F.when(in_order, x).otherwise(y)), _top(F.when(in_order, y).otherwise(x))).bitwiseAND(F.lit(0xFFFF)).cast("int") - 32768

    def select(s: Column) -> Column:
        n = F.size(s)
        both = F.sort_array(F.concat(s, marks))
        at = let(both, lambda b: F.filter(F.sequence(F.lit(0), n + SLOTS - 1), lambda i: F.get(b, i).bitwiseAND(F.lit(LAST)) == LAST))
        return F.transform(at, lambda p, j: pair(F.get(s, (p - j) % n), F.get(s, (p - j + 1) % n)).cast("short"))

    return let(F.sort_array(_elements(tokens(text))), select)


def written(sig: Column) -> Column:
    """A signature as text, four hexadecimal digits a slot."""
    return F.array_join(F.transform(sig, lambda x: F.right(F.hex(x.cast("int") + F.lit(32768 + 65536)), F.lit(4))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of slots in which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(SLOTS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, signature, fingerprint) of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("signature", signature(F.col("text"))).withColumn("fingerprint", written(F.col("signature")))


def _buckets(base: DataFrame) -> tuple[Column, Column, int]:
    """(range, bucket) of each row by place and text hash, both rising with the place, and about how many buckets there are.

    Ranges hold about as many rows each, by quantiles of the places; a place of many rows is a range of its own. A
    range is cut into buckets evenly by place, or by the text hash if it is a single place.
    """
    asked = [i / RANGES for i in range(1, RANGES)]
    seen = base.agg(F.count("*").alias("n"), F.min("doc_id").cast("long").alias("low"), F.max("place").alias("high"), F.percentile_approx("place", asked, 10 * RANGES).alias("cuts")).first()
    cuts, share = seen["cuts"] or [], seen["n"] / RANGES
    many = {v for v in cuts if cuts.count(v) > 1}
    bounds = sorted({_NULL_PLACE, *cuts, *(v + 1 for v in many), *([seen["low"]] if seen["low"] is not None else [])})
    lows, widths, pieces = [], [], []
    for low, after in zip(bounds, [*bounds[1:], (seen["high"] or 0) + 1]):
        n = max(1, -(-int(share * max(1, cuts.count(low) if low in many else 1)) // BUCKET_ROWS))
        lows.append(low)
        pieces.append(n)
        widths.append(0.0 if low in many else max(1.0, (after - low) / n))

    def fixed(values: list, kind: str) -> Column:
        return F.array(*(F.lit(v).cast(kind) for v in values))

    span = F.size(F.filter(fixed(bounds, "long"), lambda b: b <= F.col("place"))) - 1
    at = [F.get(fixed(x, kind), span) for x, kind in ((lows, "double"), (widths, "double"), (pieces, "long"))]
    by_hash = at[2] - 1 - F.least(F.floor((F.col("th") / F.lit(2.0**64) + 0.5) * at[2]), at[2] - 1)
    by_place = F.floor((F.col("place").cast("double") - at[0]) / at[1])
    return span, F.when(at[1] == 0, by_hash).otherwise(by_place).cast("long"), sum(pieces)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, signature) with next_text and next_signature: of the next document by falling id; after the last, the first.

    Rows are dealt into buckets of about BUCKET_ROWS rows; inside, a window looks ahead. The last row of a bucket gets
    the first of the next bucket, whose place and text hash are aggregated before.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_PLACE)).alias("place"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    span, bucket, buckets = _buckets(base)
    base = base.withColumn("span", span).withColumn("bucket", bucket)
    heads = base.groupBy("span", "bucket").agg(F.max(F.struct("place", F.bitwise_not("th").alias("by"))).alias("head"))
    inside = F.lead("head").over(Window.partitionBy("span").orderBy(F.col("bucket").desc()))
    down = Window.orderBy(F.col("span").desc())  # over RANGES * 2 rows at most
    firsts = heads.groupBy("span").agg(F.max("head").alias("top")).select("span", F.coalesce(F.lead("top").over(down), F.first("top").over(down)).alias("top"))
    follow = heads.withColumn("after", inside).join(F.broadcast(firsts), "span").select("span", "bucket", F.coalesce("after", "top").alias("after"))
    # one place for each bucket: broadcast while there are few, else joined by shuffling
    chosen = heads.select(F.col("head.place").alias("place"), F.bitwise_not("head.by").alias("th")).distinct()
    if buckets <= FEW_HEADS:
        chosen = F.broadcast(chosen)
    tops = base.join(chosen, ["place", "th"]).groupBy("place", "th").agg(F.min("text").alias("head_text"))
    tops = tops.select(F.struct("place", F.bitwise_not("th").alias("by")).alias("after"), "head_text", signature(F.col("head_text")).alias("head_signature"))
    after = follow.join(tops, "after").select("span", "bucket", "head_text", "head_signature")
    order = Window.partitionBy("span", "bucket").orderBy(F.col("place").desc(), "th", "text")
    rows = base.withColumn("signature", signature(F.col("text"))).select(
        "doc_id", "span", "bucket", "text", "signature", F.lead("text").over(order).alias("lead_text"), F.lead("signature").over(order).alias("lead_signature")
    )
    return rows.join(after, ["span", "bucket"], "left").select(
        "doc_id", "text", "signature", F.coalesce("lead_text", "head_text").alias("next_text"), F.coalesce("lead_signature", "head_signature").alias("next_signature")
    )


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text whose last third gives way to the beginning of the next document."""
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next_text", F.lit(1), third))
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", "edited", "signature", "next_signature", signature(F.col("edited")).alias("edited_signature"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written(F.col("signature")).alias("fingerprint"), written(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
