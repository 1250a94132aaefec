"""Documents with every awkward case, and helpers."""

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, toxicity string, open string"


def awkward(spark, texts=()):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{k % 997}" for k in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 4),
        (4, long, "en", "s", len(long)), (5, "One two three four five six", "de", "s", 27),
        (5, "One two three four five six", "de", "s", 27), (6, "...!!! ???", "fr", "s", 10),
        (None, "Text without an id", "en", "s", 18), (7, "ünïcödé 中文   text x", None, "s", 20),
        *[(100 + k, text, "en", "s", len(text)) for k, text in enumerate(texts)],
    ]
    return spark.createDataFrame([(*row, 0.1, "x", "y") for row in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rnd: random.Random, words: int, vocabulary: int = 400, tag: str = "w") -> str:
    return " ".join(f"{tag}{rnd.randint(0, vocabulary)}" for _ in range(words))


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
