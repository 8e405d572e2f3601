"""Language-model scores by prediction by partial matching, beside a word-frequency score.

The model is a trie of byte contexts of up to ORDER bytes, with the counts of what follows them in the training
texts. A symbol that a context has not seen is reached by an escape to the next shorter context (method C: a
context escapes as often as it has seen different symbols), where all symbols of the longer context are excluded.
As the model does not change while it scores, the code length of a symbol depends on its ORDER-byte context alone.

Texts are lower-cased (A-Z) and dealt into blocks by hash. Each block gathers the different n-grams and words of
its texts, with their counts in training texts; these are shuffled by n-gram, merged into the part of the trie that
holds their contexts, answered with counts or logarithms, and shuffled back to the block. So no trie and no
vocabulary is ever held in one place; only the counts of single bytes after single bytes, 257 x 257 at most, are.
Parts are dealt by the last two bytes of the context and SPLIT kinds of the byte before them, so that a frequent pair
of bytes does not fill one part; the contexts of two bytes are then summed over these parts and sent back to them. The
counts of many blocks are summed in levels of FAN blocks, and their questions are spread over copies of a part.

Defined results: a null text counts as empty, with the end token alone; equal texts get equal scores; without
training texts symbols are equally likely and no token is known; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bytehash import BLANK, Joined
from .common import SLICE_BYTES, spread, stage

ORDER = 4
SYMBOLS = 257  # bytes and the end; the end also fills contexts before the first byte
WIDTH = 9  # bits
BLOCK_BYTES, PART_KEYS = 16 << 20, 1 << 20
#: Blocks that one copy of a part answers.
BLOCKS_EACH = 512
FAN, SPLIT = 256, 8
NGRAM, WORD, TRIPLE = 0, 1, 2
#: Key of the end token among the words.
END = np.uint64(1)
REQUEST = "part int, block int, kind int, keys binary, counts binary"
MODEL = "part int, kind int, keys binary, counts binary, pairs array<struct<pair: int, n: long>>, different long, total long"
ANSWER = "block int, kind int, keys binary, values binary"


def _mask(symbols: int) -> np.uint64:
    return np.uint64((1 << WIDTH * symbols) - 1)


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text, end included: its context and itself in one number; and how many each text has."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    fill = b"\x00" * ORDER
    data = np.frombuffer(b"".join(fill + t + b"\x00" for t in texts), np.uint8)
    lower = np.arange(256, dtype=np.uint64) + np.uint64(1)
    lower[65:91] += np.uint64(32)
    symbols = lower[data]
    starts = np.cumsum(lengths + ORDER) - lengths - ORDER
    for k in range(ORDER):
        symbols[starts + k] = 0
    symbols[starts + ORDER + lengths - 1] = 0
    n = len(symbols) - ORDER
    code = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        code = (code << np.uint64(WIDTH)) | symbols[k : k + n]
    keep = np.ones(n + ORDER, bool)
    for k in range(ORDER):
        keep[starts + k] = False
    return code[keep[ORDER:]], lengths


def _grouped(texts: list[bytes]):
    """Slices of positions of texts with about SLICE_BYTES each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += len(t) + ORDER
    if start < len(texts):
        yield start, len(texts)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of equal keys, by key."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, with how often they occur where ``seen`` holds: one sort, of keys with that bit appended."""
    marked = np.sort(keys << np.uint64(1) | seen)
    found = marked >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    ones = (marked & np.uint64(1)).astype(np.int64)
    return found[first], np.add.reduceat(ones, first) if len(first) else ones


def _word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of texts, the end among them, below 2^63; and how many each text has."""
    hashes, counts = Joined(texts, True).words()
    keys = (hashes >> np.uint64(2) << np.uint64(1))
    return np.insert(keys, np.cumsum(counts), END), counts + 1


def _part_of(keys: np.ndarray, kind: int, parts: int) -> np.ndarray:
    """n-grams go by the last two bytes of their context and the kind of the one before, triples by their first two, words by their own value."""
    if kind == WORD:
        by = keys >> np.uint64(1)
    else:
        by = keys >> np.uint64(WIDTH) & _mask(2)
        if kind == NGRAM:
            by = by | (keys >> np.uint64(3 * WIDTH) & np.uint64(SPLIT - 1)) << np.uint64(2 * WIDTH)
    return ((by * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _request(parts: int):
    def run(table: pa.Table) -> pa.Table:
        texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        train = np.array(table.column("train").to_pylist(), bool)
        block = table.column("block")[0].as_py()
        gathered = {NGRAM: [], WORD: []}
        for a, b in _grouped(texts):
            for kind, of in ((NGRAM, codes), (WORD, _word_keys)):
                keys, counts = of(texts[a:b])
                gathered[kind].append(_counted(keys, np.repeat(train[a:b], counts).astype(np.uint64)))
                if sum(len(k) for k, _ in gathered[kind]) > 1 << 22:
                    gathered[kind] = [_merge(gathered[kind])]
        rows = []
        for kind, found in gathered.items():
            keys, counts = _merge(found)
            to = _part_of(keys, kind, parts)
            order = np.argsort(to, kind="stable")
            keys, counts, to = keys[order], counts[order], to[order]
            edges = np.searchsorted(to, np.arange(parts + 1))
            rows += [(p, block, kind, keys[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "block", "kind", "keys", "counts"])

    return run


def _read(table: pa.Table, kind: int, counts: str, kind_of_count) -> list[tuple[np.ndarray, np.ndarray]]:
    chosen = table.filter(pa.compute.equal(table.column("kind"), kind))
    return [(np.frombuffer(k, np.uint64), np.frombuffer(c, kind_of_count)) for k, c in zip(chosen.column("keys").to_pylist(), chosen.column(counts).to_pylist())]


def _summed(table: pa.Table, kind: int, kind_of_count) -> tuple[np.ndarray, np.ndarray]:
    """Sums for keys that training texts hold, and one key without count for each pair of bytes that is asked for only."""
    found = []
    for k, c in _read(table, kind, "counts", kind_of_count):
        keep = c > 0
        if kind == NGRAM:
            keep[np.unique(k >> np.uint64(WIDTH) & _mask(2), return_index=True)[1]] = True
        found.append((k[keep], c[keep].astype(np.int64)))
    return _merge(found)


def _sum_up(kind_of_count):
    """The counts of FAN blocks, or sums of such."""

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        part, above, rows = table.column("part")[0].as_py(), table.column("above")[0].as_py(), []
        for kind in (NGRAM, WORD):
            keys, counts = _summed(table, kind, kind_of_count)
            rows.append((part, above, kind, keys.tobytes(), counts.tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "above", "kind", "keys", "counts"])

    return run


def _gather(kind_of_count):
    """One part: all counts summed, for keys that training texts hold; and those of its contexts of two bytes and of one."""

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        part, rows = table.column("part")[0].as_py(), []
        for kind in (NGRAM, WORD):
            keys, counts = _summed(table, kind, kind_of_count)
            pairs = []
            if kind == NGRAM:
                three, sums = _merge([(keys & _mask(3), counts)])
                rows.append((part, TRIPLE, three.tobytes(), sums.tobytes(), [], 0, 0))
                keys, counts = keys[counts > 0], counts[counts > 0]
                two, sums = _merge([(keys & _mask(2), counts)])
                pairs = [{"pair": p, "n": n} for p, n in zip(two.tolist(), sums.tolist())]
            rows.append((part, kind, keys.tobytes(), counts.tobytes(), pairs, len(keys), int(counts.sum())))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.struct([("pair", pa.int32()), ("n", pa.int64())])), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "kind", "keys", "counts", "pairs", "different", "total"])

    return run


def _deal(parts: int):
    """Triples of a part, by where their first two bytes are summed."""

    def run(batches):
        for batch in batches:
            for part, k, c in zip(*(batch.column(x).to_pylist() for x in ("part", "keys", "counts"))):
                keys, counts = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                to = _part_of(keys, TRIPLE, parts)
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(parts + 1))
                rows = [(p, part, keys[order[a:b]].tobytes(), counts[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["dealt", "part", "keys", "counts"])

    return run


def _complete(table: pa.Table) -> pa.Table:
    """For each part, all symbols that follow the pairs of bytes that it holds or is asked for, with their sums over all parts."""
    sent = [(p, np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)) for p, k, c in zip(*(table.column(x).to_pylist() for x in ("part", "keys", "counts")))]
    keys, counts = _merge([(k[c > 0], c[c > 0]) for _, k, c in sent])
    rows = []
    for part, k, _ in sent:
        mine = np.isin(keys >> np.uint64(WIDTH), k >> np.uint64(WIDTH))
        rows.append((part, TRIPLE, keys[mine].tobytes(), counts[mine].tobytes()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "kind", "keys", "counts"])


class Trie:
    """Contexts of one part as levels of sorted arrays; the three lowest levels are those of the whole corpus."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, triples: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """pairs: how often each symbol (column) follows each single byte (row); triples: and the pairs of bytes of this part, if not all is here."""
        self.levels: list[tuple] = []  # from ORDER down to 2: (entries, counts, contexts, totals, numbers of symbols)
        for order in range(ORDER, 1, -1):
            if order == 2 and triples is not None:
                k, c = triples
            else:
                k, c = (keys, counts) if order == ORDER else _merge([(self.levels[-1][0] & _mask(order + 1), self.levels[-1][1])])
            context = k >> np.uint64(WIDTH)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(k) else np.zeros(0, np.int64)
            self.levels.append((k, c, context[first], np.add.reduceat(c, first) if len(first) else c, np.diff(np.append(first, len(k))), first))
        self.pairs, self.singles = pairs, pairs.sum(axis=0)
        self.pair_totals, self.pair_symbols = pairs.sum(axis=1), (pairs > 0).sum(axis=1)
        #: for each context: what its symbols weigh in the next shorter one, which excludes them
        self.excluded = []
        for i, (k, _, _, _, _, first) in enumerate(self.levels):
            if i + 1 < len(self.levels):
                below = k & _mask(ORDER - i)
                weight = self.levels[i + 1][1][np.searchsorted(self.levels[i + 1][0], below)] if len(k) else np.zeros(0, np.int64)
            else:
                weight = pairs[(k >> np.uint64(WIDTH) & _mask(1)).astype(int), (k & _mask(1)).astype(int)]
            self.excluded.append(np.add.reduceat(weight, first) if len(first) else weight)
        self.single_excluded = ((pairs > 0) * self.singles).sum(axis=1)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def log10(self, wanted: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol in its context."""
        n = len(wanted)
        p, open_ = np.ones(n), np.ones(n, bool)
        less, fewer = np.zeros(n), np.zeros(n)  # weight and number of excluded symbols at the present order

        def level(count: np.ndarray, total: np.ndarray, symbols: np.ndarray, known: np.ndarray) -> None:
            nonlocal p, open_
            whole, kinds = np.maximum(total - less, 0), np.maximum(symbols - fewer, 0)
            all_of = whole + kinds
            use = open_ & known & (all_of > 0)
            hit = use & (count > 0)
            escape = use & ~hit & (kinds > 0)
            p[hit] *= count[hit] / all_of[hit]
            p[escape] *= kinds[escape] / all_of[escape]
            open_ = open_ & ~hit

        for i, (k, c, contexts, totals, symbols, _) in enumerate(self.levels):
            code = wanted & _mask(ORDER + 1 - i)
            at, hit = self._find(k, code)
            ctx, known = self._find(contexts, code >> np.uint64(WIDTH))
            if not len(contexts):
                less, fewer = np.zeros(n), np.zeros(n)
                continue
            level(np.where(hit, c[at], 0), totals[ctx], symbols[ctx], known)
            less, fewer = np.where(known, self.excluded[i][ctx], 0), np.where(known, symbols[ctx], 0)
        byte, symbol = (wanted >> np.uint64(WIDTH) & _mask(1)).astype(int), (wanted & _mask(1)).astype(int)
        level(self.pairs[byte, symbol], self.pair_totals[byte], self.pair_symbols[byte], self.pair_totals[byte] > 0)
        less, fewer = self.single_excluded[byte].astype(float), self.pair_symbols[byte].astype(float)
        level(self.singles[symbol], np.full(n, self.singles.sum()), np.full(n, (self.singles > 0).sum()), np.full(n, self.singles.sum() > 0))
        rest = max(1, SYMBOLS - int((self.singles > 0).sum()))
        return np.log10(np.where(open_, p / rest, p))


def _answer(pairs):
    def run(requests: pa.Table, model: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        rows = []
        for kind in (NGRAM, WORD):
            keys, counts = _merge(_read(model, kind, "counts", np.int64))
            trie = Trie(keys, counts, pairs.value, _merge(_read(model, TRIPLE, "counts", np.int64))) if kind == NGRAM else None
            asked = requests.filter(pa.compute.equal(requests.column("kind"), kind))
            for block, raw in zip(asked.column("block").to_pylist(), asked.column("keys").to_pylist()):
                wanted = np.frombuffer(raw, np.uint64)
                if trie:
                    values = trie.log10(wanted)
                else:
                    at, hit = Trie._find(keys, wanted)
                    values = np.where(hit, counts[at] if len(counts) else 0, 0).astype(np.float64)
                rows.append((block, kind, raw, values.tobytes()))
        columns = list(zip(*rows)) or [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["block", "kind", "keys", "values"])

    return run


class _Lookup:
    """Values by key, through a table of slots of which most keys find theirs at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.uint64(1 << 63)), np.append(values[order], 0.0)
        self.slot = np.full(1 << self.bits, len(keys), np.int32)
        self.slot[self._hash(self.keys[:-1])] = np.arange(len(keys), dtype=np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot[self._hash(keys)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        at[wrong] = np.searchsorted(self.keys, keys[wrong])
        return self.values[at]


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(train_tokens: int, different: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        texts = [t or b"" for t in docs.column("text").cast(pa.binary()).to_pylist()]
        found = {}
        for kind in (NGRAM, WORD):
            pairs = _read(answers, kind, "values", np.float64)
            found[kind] = _Lookup(np.concatenate([k for k, _ in pairs] or [np.zeros(0, np.uint64)]), np.concatenate([v for _, v in pairs] or [np.zeros(0)]))
        n_tokens, n_known, base, score = [], [], [], []
        below = np.log10(train_tokens + 0.5 * (different + 1))
        for a, b in _grouped(texts):
            keys, counts = codes(texts[a:b])
            score.append(np.add.reduceat(found[NGRAM](keys), np.cumsum(counts) - counts))
            keys, counts = _word_keys(texts[a:b])
            c, first = found[WORD](keys), np.cumsum(counts) - counts
            n_tokens.append(counts)
            n_known.append(np.add.reduceat((c > 0).astype(np.int64), first))
            base.append(np.add.reduceat(np.log10(c + 0.5), first) - counts * below)
        train = docs.column("train").combine_chunks() if docs.num_rows else pa.array([], pa.bool_())
        columns = [docs.column("doc_id"), pa.compute.invert(train), *(pa.array(np.concatenate(x)) for x in (n_tokens, n_known)), pa.array(np.full(docs.num_rows, train_tokens)), *(pa.array(np.concatenate(x)) for x in (base, score))]
        return pa.Table.from_arrays(columns, [x.split()[0] for x in SCORED.split(", ")])

    return run


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Scores of all ``docs`` by a model of those for which ``train`` holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), train.alias("train"))
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    blocks = spread(spark, held["n"] + 64 * held["rows"], BLOCK_BYTES)
    parts = spread(spark, held["n"] // 32, PART_KEYS)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    requests = stage(dealt.groupBy("block").applyInArrow(_request(parts), REQUEST), "lm-requests")
    counts, kind_of_count, groups = requests.select("part", F.floor(F.col("block") / FAN).cast("int").alias("above"), "kind", "keys", "counts"), np.uint32, -(-blocks // FAN)
    while groups > 1:
        counts = counts.groupBy("part", "above").applyInArrow(_sum_up(kind_of_count), "part int, above int, kind int, keys binary, counts binary").withColumn("above", F.floor(F.col("above") / FAN).cast("int"))
        kind_of_count, groups = np.int64, -(-groups // FAN)
    model = stage(counts.groupBy("part").applyInArrow(_gather(kind_of_count), MODEL), "lm-model")
    words = model.where(F.col("kind") == WORD).agg(F.sum("different").alias("different"), F.sum("total").alias("total")).first()
    pairs = np.zeros((SYMBOLS, SYMBOLS))
    for r in model.select(F.explode("pairs").alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("n")).collect():  # at most SYMBOLS ** 2
        pairs[r["pair"] >> WIDTH, r["pair"] & (1 << WIDTH) - 1] = r["n"]
    copies = -(-blocks // BLOCKS_EACH)
    asked = requests.select("part", "block", "kind", "keys", F.pmod("block", F.lit(copies)).alias("copy"))
    triples = model.where(F.col("kind") == TRIPLE).select("part", "keys", "counts").mapInArrow(_deal(parts), "dealt int, part int, keys binary, counts binary")
    triples = triples.groupBy("dealt").applyInArrow(_complete, "part int, kind int, keys binary, counts binary")
    whole = model.where(F.col("kind") != TRIPLE).select("part", "kind", "keys", "counts").union(triples)
    given = whole.select("part", "kind", "keys", "counts", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    answers = asked.groupBy("part", "copy").cogroup(given.groupBy("part", "copy")).applyInArrow(_answer(spark.sparkContext.broadcast(pairs)), ANSWER)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(words["total"] or 0, words["different"] or 0), SCORED)
