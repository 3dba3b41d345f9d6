import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"

#: Names that the operators use inside; a table's own columns of these names
#: must do no harm.
CLASHING = "node key u v rep component size start end shard at body prefix open kept keep_id words hits text_ block hash row q taken n".split()


@pytest.fixture(scope="session")
def small_docs(spark):
    """(doc_id, text) of the smallest table."""
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_rows():
    """Nulls, empty, tiny and long texts, ties, repeated rows, copies."""
    draw = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "ab", "the", "of", "x1", "Zeta!", "κ"]
    prose = [" ".join(draw.choices(vocabulary, k=90)) for _ in range(6)]
    near = prose[0].split(" ")
    near[40] = "changed"
    rows = [
        (1, prose[0], "a"),
        (2, " ".join(near), "a"),
        (3, prose[0].replace(" ", "\n"), None),
        (3, prose[0].replace(" ", "\n"), None),
        (4, None, "b"),
        (5, "", "b"),
        (6, " \t\n", "b"),
        (7, "one", "c"),
        (8, "one", "c"),
        (9, prose[1] + " " + prose[2][:200], "c"),
        (10, prose[2], None),
        (11, "x" * 300, "é"),
        (12, "y" + "x" * 299, "é"),
        (13, " ".join(prose) * 12, "a"),
        (None, prose[1], "a"),
        (None, prose[3], "b"),
        (14, "under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0 the the the the", "b"),
        (15, "<|im_end|> \\<| é \u0085 it's 12345 \x1c　 a\r\nb", "b"),
        (-5, prose[4], "z"),
        (16, prose[4], "z"),
        (17, prose[5][:49], "z"),
        (18, prose[5][:50], "z"),
        (19, prose[5], "z"),
        (20, prose[5][:50], "z"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, *["clash"] * len(CLASHING)) for r in odd_rows()]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=repr)
