"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

Words (the matches of the pattern) never influence each other, so a set of words is encoded at once: their bytes lie in
one array of tokens, and an inverted index holds, for each merge, the positions of the pairs it applies to. Merges are
replayed in the order of their ranks. One merge visits only its own positions and there changes only the two
neighbours, whose new pairs go to the index of later merges. A word that a corpus holds a million times is merged once.

A task does this for all different words of its texts, ``STEP`` bytes of text at a time, which is its part of the corpus
under the usual sizes of partitions. So no words are shuffled, a lost task is repeated by itself, and what a worker holds
is bounded by the step, or by a single text where one is longer.

The result is that of always merging the leftmost pair of lowest rank. Where the token that a merge makes is part of a
token of lower rank, only the leftmost place in each word is merged at a time, as a lower rank may have to come before
the next one; else all places are, from left to right.

Defined results: a null text counts as empty and has no ids; equal rows have equal ids; a column named ``ids`` or
``decoded`` is replaced, all others stay; null ids decode to null; an id that the vocabulary does not have is an error.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from .common import slices, text_bytes

#: Bytes of text whose words are replayed together, and of those whose ids travel in one Arrow batch. They bound memory only.
STEP, SLICE = 8 << 20, 4 << 20
#: Places of one merge from which they are merged as arrays.
MANY = 32
_BITS = 24
_EDGE = (1 << _BITS) - 1


class Merges:
    """Ranks of a vocabulary as merges: which id two neighbouring ids become."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a rank: {missing[:5]}")
        self.token = {r: t for t, r in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.of_pair: dict[int, int] = {}
        #: Tokens that are part of a token of lower rank.
        self.leftmost_only: set[int] = set()
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.of_pair[a << _BITS | b] = rank
                    self.leftmost_only.update(x for x in (a, b) if x > rank)
        keys = sorted(self.of_pair)
        self._pairs = np.array([*keys, 1 << 62], np.int64)
        self._ranks = np.array([*(self.of_pair[k] for k in keys), -1], np.int32)
        self.first = np.full((256, 256), -1, np.int32)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = self.of_pair.get(int(self.of_byte[a]) << _BITS | int(self.of_byte[b]), -1)


    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 where they do not merge."""
        key = left.astype(np.int64) << _BITS | right
        at = np.searchsorted(self._pairs, key)
        return np.where(self._pairs[at] == key, self._ranks[at], -1)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    return Merges(read_ranks(path))


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and where those of each word begin and the last ends."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # an edge follows each word
    data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    edges = starts[1:] - 1
    ids = merges.of_byte[data]
    ids[edges] = _EDGE
    ranks = np.full(len(data), -1, np.int32)
    ranks[:-1] = merges.first[data[:-1], data[1:]]
    ranks[edges] = -1
    ranks[np.maximum(edges - 1, 0)] = -1  # the last byte of a word has no pair, and an empty word has none
    after, before = np.arange(1, len(data) + 1, dtype=np.int32), np.arange(-1, len(data) - 1, dtype=np.int32)
    index: dict[int, list[int]] = {}
    pending: list[int] = []

    def add(places: np.ndarray, ranks: np.ndarray) -> None:
        """Enters pairs into the index, those of one rank together."""
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        first = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        bounds, places = [*first.tolist(), len(ranks)], places.tolist()
        for rank, a, b in zip(ranks[first].tolist(), bounds[:-1], bounds[1:]):
            if rank in index:
                index[rank] += places[a:b]
            else:
                index[rank] = places[a:b]
                heappush(pending, rank)

    paired = np.flatnonzero(ranks >= 0)
    if len(paired):
        add(paired, ranks[paired])
    # the same memory, read one by one where a merge has few places and as arrays where it has many
    one_id, one_after, one_before = memoryview(ids), memoryview(after), memoryview(before)
    of_pair, leftmost_only, begin = merges.of_pair.get, merges.leftmost_only, starts.tolist()
    while pending:
        rank = heappop(pending)
        places = index.pop(rank)
        places.sort()
        alone = rank in leftmost_only
        if len(places) >= MANY:
            i = np.array(places, np.int32)
            i = i[ids[i] >= 0]
            i = i[merges.ranks_of(ids[i], ids[after[i]]) == rank]
            if alone:
                word = np.searchsorted(starts, i, "right")
                first = np.concatenate([[True], word[1:] != word[:-1]])[: len(i)]
                if not first.all():
                    index[rank] = i[~first].tolist()
                    heappush(pending, rank)
                i = i[first]
            j = after[i]
            if not (j[:-1] == i[1:]).any():  # no pair begins where the one before ends
                k, h = after[j], before[i]
                ids[i], ids[j], after[i], before[k] = rank, -1, k, i
                at = np.concatenate([h[h >= 0], i])
                new = merges.ranks_of(ids[at], ids[after[at]])
                met = new >= 0
                if met.any():
                    add(at[met], new[met])
                continue
            places = i.tolist()
        elif alone:
            chosen, later, last = [], [], -1
            for i in places:
                # a place whose pair is gone by now must not stand for its word
                a = one_id[i]
                if a >= 0 and of_pair(a << _BITS | one_id[one_after[i]]) == rank:
                    word = bisect_right(begin, i)
                    (later if word == last else chosen).append(i)
                    last = word
            if later:
                index[rank] = later
                heappush(pending, rank)
            places = chosen
        for i in places:
            a = one_id[i]
            if a < 0:
                continue
            j = one_after[i]
            if of_pair(a << _BITS | one_id[j]) != rank:
                continue
            k, h = one_after[j], one_before[i]
            one_id[i], one_id[j], one_after[i], one_before[k] = rank, -1, k, i
            for place, new in ((h, of_pair(one_id[h] << _BITS | rank) if h >= 0 else None), (i, of_pair(rank << _BITS | one_id[k]))):
                if new is not None:
                    if new in index:
                        index[new].append(place)
                    else:
                        index[new] = [place]
                        heappush(pending, new)
    kept = (ids >= 0) & (ids != _EDGE)
    return ids[kept], np.concatenate([[0], np.cumsum(kept)])[starts]


#: White space beyond ASCII, as characters and in UTF-8.
_WIDE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE_BYTES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Chunks end where matches of the usual pattern end: white space but for the blank or line feed before a chunk, and what has none.
#: A match of that pattern has white space at its start only, or has nothing else.
CHUNKS = re.compile(rf"[ \n]?[^\t-\r {_WIDE}]+|[\t-\r {_WIDE}]+(?![^\t-\r {_WIDE}])|[\t-\r {_WIDE}]+")
_USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def chunk_starts(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where the chunks of joined texts without wide white space begin; ``docs`` are the places where texts begin, and the end."""
    white = _WHITE[data]
    before = np.concatenate([[False], white[:-1]])
    more = np.concatenate([white[1:], [True]])  # white space or the text's end follows
    more[docs[1:][docs[1:] > 0] - 1] = True
    soft = np.concatenate([[False], (data[:-1] == 32) | (data[:-1] == 10)])
    begins = (white & ~(before & more)) | (before & ~white & ~soft)
    begins[docs[:-1][docs[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Encodes texts by replay over their different words.

    Under the usual pattern, texts are cut into chunks first and the pattern is matched within different chunks only.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.merges, self.words = merges_of(path), regex.compile(pattern)
        self.usual = pattern == _USUAL

    def _chunks(self, texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The chunks of all texts in a row, and the number of the first one of each text, and of all."""
        plain = [self.usual and not _WIDE_BYTES.search(t) for t in texts]
        cut = [None if p else [m.encode() for m in (CHUNKS if self.usual else self.words).findall(t.decode())] for t, p in zip(texts, plain)]
        texts = [t if c is None else b"".join(c) for t, c in zip(texts, cut)]
        docs = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = chunk_starts(data, docs) if len(data) else np.zeros(0, np.int64)
        if not all(plain):
            inside = np.repeat(plain, np.diff(np.searchsorted(starts, docs)))
            others = [docs[i] + np.concatenate([[0], np.cumsum([len(x) for x in c[:-1]], dtype=np.int64)]) for i, c in enumerate(cut) if c]
            starts = np.sort(np.concatenate([starts[inside], *others]))
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(data)])
        return chunks.dictionary_encode(), np.searchsorted(starts, docs)

    def encode(self, texts: list[bytes]) -> Iterator[pa.ListArray]:
        """The ids of the texts, those of about SLICE bytes at a time."""
        chunks, docs = self._chunks(texts)
        cut = list(map(self.words.findall, chunks.dictionary.cast(pa.string()).to_pylist())) if self.usual else [[c.decode()] for c in chunks.dictionary.to_pylist()]
        number: dict[str, int] = defaultdict(itertools.count().__next__)
        in_chunks = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(cut)), np.int32)
        counts = np.concatenate([[0], np.cumsum(list(map(len, cut)), dtype=np.int64)])
        del cut
        ids, ends = replay([w.encode() for w in number], self.merges)
        del number
        of_word = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
        words = of_word.take(pa.array(in_chunks))
        of_chunk = pa.ListArray.from_arrays(pa.array(words.offsets.to_numpy()[counts], pa.int32()), words.values)
        held, first = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= SLICE or i == len(texts) - 1:
                found = of_chunk.take(chunks.indices[docs[first] : docs[i + 1]])
                yield pa.ListArray.from_arrays(pa.array(found.offsets.to_numpy()[docs[first : i + 2] - docs[first]], pa.int32()), found.values)
                held, first = 0, i + 1


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != name]
    return pa.RecordBatch.from_arrays([*(c for _, c in kept), values], [*(n for n, _ in kept), name])


def _schema(df: DataFrame, name: str, kind) -> StructType:
    return StructType([f for f in df.schema if f.name != name]).add(name, kind)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of about STEP bytes."""
    step, held = [], 0
    for batch in batches:
        if step and held + batch.nbytes > STEP:
            yield step
            step, held = [], 0
        step.append(batch)
        held += batch.nbytes
    if step:
        yield step


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids``: those of ``text`` by the rank file at ``path``, each match of ``pattern`` by itself, without special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for step in _steps(slices(batches, size=SLICE)):
            whole = pa.Table.from_batches(step).combine_chunks().to_batches()[0]
            first = 0
            for ids in encoder.encode(text_bytes(whole.column("text"))):
                yield _with(whole.slice(first, len(ids)), "ids", ids)
                first += len(ids)

    return docs.mapInArrow(run, _schema(docs, "ids", ArrayType(IntegerType())))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``decoded``: the bytes of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(path)
        tokens = pa.array([merges.token.get(i) for i in range(max(merges.token) + 1)], pa.binary())
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.flatten()
            found = tokens.take(flat)
            if found.null_count:
                raise ValueError(f"id {flat.filter(found.is_null())[0]} is not in the vocabulary")
            # the tokens lie in a row, so a text is the bytes from its first to its last
            at = np.frombuffer(found.buffers()[1], np.int32)[found.offset :][np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])]
            decoded = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.astype(np.int32)), found.buffers()[2]])
            yield _with(batch, "decoded", pc.if_else(ids.is_null(), pa.scalar(None, pa.binary()), decoded))

    return rows.mapInArrow(run, _schema(rows, "decoded", BinaryType()))
