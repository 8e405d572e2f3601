import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textmill.llm import byte_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_against_the_library(docs, rows, empty, library):
    found = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH)
    assert set(docs.columns) <= set(found.columns)
    want = Counter((r[0], tuple(library.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in found.collect()) == want
    assert byte_bpe.decode(byte_bpe.encode(empty, PATH, PATTERN), PATH).count() == 0


def encoded(texts, pattern=PATTERN):
    return [ids for part in byte_bpe.Encoder(PATH, pattern).encode([t.encode() for t in texts]) for ids in part.to_pylist()]


def test_of_all_kinds_of_texts(library):
    pick = random.Random(3)
    anything = lambda: chr(pick.choice([pick.randrange(32, 127), pick.randrange(9, 0x600), pick.randrange(0x600, 0xD800), pick.randrange(0xE000, 0x10000)]))
    texts = ["".join(anything() for _ in range(pick.randint(0, 60))) for _ in range(600)]
    texts += ["".join(pick.choices("aAthe ing  \n\tsébanan’'ll't\x1c　", k=pick.randint(0, 200))) for _ in range(1500)]
    texts += ["a" * 5000, "", "ab" * 3000, " " * 400, " \n \n\n  x", "\x1c\x1d a\x1e!", "日本語" * 50]
    texts += [" \u3000x", "\u3000 \u3000x y", "a\xa0 b\n\u2028", "\tx \n", "x \t", "\n\nx\r\ny  z"]
    wrong = [t for t, ids in zip(texts, encoded(texts)) if ids != library.encode_ordinary(t)]
    # characters that only one of the two libraries knows already
    assert len(wrong) <= 3


@pytest.mark.parametrize("many", [1, 10**9])
def test_one_by_one_and_as_arrays(monkeypatch, library, many):
    monkeypatch.setattr(byte_bpe, "MANY", many)
    pick = random.Random(9)
    words = ["".join(pick.choices("abnthe sing", k=pick.randint(0, 40))).encode() for _ in range(700)] + [b"a" * 99, b""]
    ids, ends = byte_bpe.replay(words, byte_bpe.merges_of(PATH))
    single = [library._core_bpe.encode_single_piece(w) if w else [] for w in words]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == single


def test_slices_and_other_patterns(monkeypatch, library):
    text = "The thing, then; the other thing\n and 33 more. " * 400
    whole = library.encode_ordinary(text)
    monkeypatch.setattr(byte_bpe, "SLICE", 1000)
    assert encoded([text, "a", text[:700], ""]) == [whole, library.encode_ordinary("a"), library.encode_ordinary(text[:700]), []]
    assert encoded([text, " x"], PATTERN + "|~") == [whole, library.encode_ordinary(" x")]


def test_lower_ranks_that_appear_late():
    """A merge may make a pair of lower rank, which then comes before the next place of the same merge."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"xab": 3, b"ab": 5, b"ba": 4, b"bab": 6}
    merges = byte_bpe.Merges(ranks)

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    pick = random.Random(2)
    words = ["".join(pick.choices("abx", k=pick.randint(1, 12))).encode() for _ in range(500)]
    for many in (1, 10**9):
        byte_bpe.MANY, kept = many, byte_bpe.MANY
        ids, ends = byte_bpe.replay(words, merges)
        byte_bpe.MANY = kept
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [plain(w) for w in words]


def test_query_digests(spark, tmp_path, rows, library):
    from textmill.llm.queries import op12_byte_bpe

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), digest(",".join(map(str, ids)).encode()), digest((r[1] or "").encode()))] += 1
    assert Counter(tuple(r) for r in op12_byte_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_unknown_ids_fail(spark):
    few = byte_bpe.decode(spark.createDataFrame([(None,), ([64, 220],), ([],), ([64],)], "ids array<int>").coalesce(1), PATH).collect()
    assert [r["decoded"] and bytes(r["decoded"]) for r in few] == [None, b"a ", bytearray(), b"a"]
    with pytest.raises(Exception, match="60000"):
        byte_bpe.decode(spark.createDataFrame([([60000],)], "ids array<int>"), PATH).where(F.col("decoded").isNotNull()).collect()
