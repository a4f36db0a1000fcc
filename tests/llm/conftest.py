import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, n int, token string, line string, size string, target string, copy string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, rows):
    """Documents (doc_id, text, source) with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "a", 1, "b", "c", "d", "e", "f") for i, t, s in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, copies and near copies, few words, other scripts, a very long text."""
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "other"
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, base, "a"), (5, base, "b"), (6, " ".join(near), "b"), (7, "one two", "c"), (8, "One TWO", "c"), (8, "One TWO", "c")]
    rows += [(9, prose(9, 30_000), "c"), (10, "Zürich 中文 ñandú\nline two\nline two\n\n" * 3, None), (11, "x" * 50_000, "b"), (12, base + " " + prose(3, 20), "a"), (13, "a b c d e", "a"), (14, "Licensed under the Apache License, Version 2.0.\nA b.", "a")]
    return rows + [(20 + k, prose(100 + k, 40 + k) + "\n" + prose(500, 12), "abc"[k % 3]) for k in range(30)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table(spark, odd_rows)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
