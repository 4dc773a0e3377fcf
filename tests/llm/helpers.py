"""Small documents with everything that goes wrong, and brute-force words."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k string, row string, part int, _t int, hash string, shard int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ne", "ru", "ti", "so", "va"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows(texts):
    return [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None if t is None else len(t), "k", "r", 1, 2, "h", 3) for i, t in enumerate(texts)]


def awkward(spark):
    """Nulls, empty and blank texts, one very long text, repeated rows, a null id, extra columns with clashing names."""
    texts = [None, "", "   \n", "one", "Two words", prose(1, 80), prose(1, 80), prose(2, 30_000), "é ß 漢字 \U0001f600 " + prose(3, 60), "!!! ???", "a  b\tc\r\n\n d "]
    made = rows(texts)
    made += [made[5], made[5], (None, prose(4, 70), None, None, None, "k", "r", 1, 2, "h", 3), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(made, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
