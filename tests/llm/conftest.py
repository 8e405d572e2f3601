import random
import zlib

import pytest

WORDS = ["".join(random.Random(i).choices("abcdefghinorstuéß", k=random.Random(-i - 1).randint(2, 8))) for i in range(400)]


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))


def cases() -> list[tuple]:
    """Documents with nulls, empty and long texts, ties, copies, near copies and shared passages."""
    base, passage = prose(1, 120), prose(99, 70)
    rows = [(i, prose(i, 20 + i % 60), "en" if i % 2 else "de", f"s{i % 3}") for i in range(40)]
    rows += [(100, base, "en", "s0"), (101, base, "en", "s0"), (102, base.replace(" ", "  ", 3), "de", None), (103, base + " " + prose(7, 8), None, "s1"), (104, base.upper(), "en", "s1")]
    rows += [(110 + k, prose(200 + k, 40) + " " + passage + " " + prose(300 + k, 40), "de", "s2") for k in range(4)]
    rows += [(120, "", "en", "s0"), (121, None, "en", "s0"), (122, " \n\t ", None, None), (123, "one two", "en", "s1"), (124, "one two", "en", "s1"), (125, "12 + 34 = 46", "en", "s1")]
    rows += [(130, "ab " * 900, "en", "s2"), (131, "x" * 5000, "en", "s2"), (132, prose(5, 6000), "en", "s0"), (133, "ñandú 日本語 <|endoftext|> naïve’s don't 3½ " * 9, "de", "s0")]
    rows += [(None, prose(77, 50), "en", "s0"), (None, None, None, None), (140, prose(140, 30), "en", "s1"), (140, prose(140, 30), "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return cases()


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clash = {c: F.lit(c) for c in ("hash", "block", "size", "class", "row", "root", "score", "words", "n", "kept_sha256", "media", "component", "before", "salt", "of_hash")}
    return frame.withColumns(clash)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus
