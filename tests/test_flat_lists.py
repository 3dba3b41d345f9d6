"""List texts read in the JVM against Python's own evaluation."""

import random

from pyspark.sql import functions as F

from trendlens.functions import brands as fb
from trendlens.sources import fixtures as fx

CELLS = [
    None, "", "[]", "()", "[ ]", "[,]", "('a')", "('a',)", "'a','b'", "'a',", " ['a']\n", "\t('x', 'y' , ) ", "'a'", "1, 2", "1,\n2",
    r"['it\'s', \"q\"]", r"""["it\'s", 'say "x"', 'a\\b', '\d\w']""", r"['\x41\x7e\xe9', '\101\60\7', 'é你', '\U0001f600', '﻿x']",
    r"['😀']", r"['\U00110000']", r"['\U0000d800']", r"['\xg1']", r"['\u12']", r"['\N{BULLET}']", r"['\a\b\f\n\r\t\v\0']", "['a\\\nb']",
    "['a\nb']", "['a\tb']", "[\n'a',\r\n 'b'\n]", "[1, -2, +3, 00, -0, 007, 10000000000000000000000]", "[2.5, 2.50, 0.0, -0.0, +1.250, 0.0001, 0.00001]",
    "[123456789.123456, 1234567890.5]", "[1e5]", "[.5]", "[1.]", "[1_000]", "[0x1F]", "[1+2j]", "[True, False, None, 'None', 'x']", "[true]", "[Nonex]",
    "['a' 'b']", "[['a'], 'b']", "['a', ('b',)]", "[{'a': 1}]", "{'a', 'b'}", "['''a''']", "[u'x', U\"y\"]", "[r'\\n']", "[b'x']", "['a', # c\n'b']",
    "['a']]", "['a'", "['a',,'b']", "['ab", "a, b", "('a', 'b'", "['a'] ['b']", "['a'], 'b'", "['你好', 'é😀']", "[' x']", " ['a',]", "['',\"\"]",
    "[1, -2, +3, 00, -0]", r"['\u00e9\u4f60', '\ufeffx', '\U0000FEFF']", r"['\ud83d\ude00']", r"['\ud800']", r"['\uDFFFx']", "[-0.0, 0.10]",
    "('a' , None)", "None, 'a'", "['x,y', '[z]', '(', \"'\"]", "['\\']", "['\\\\']", "['\\\\', ]", "['a\x0cb', ]",
]


def _compare(spark, cells):
    # a cell that Python would read otherwise must be among the undecided ones
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    out = df.select("i", "c", fb.parse_brands("c", exact="jvm").alias("got"), fb.is_undecided("c").alias("open")).collect()
    read = 0
    for r in out:
        expected = fb.literal_list(r.c) or []
        if r.open:
            assert r.got == []
        else:
            assert r.got == expected, (r.c, r.got, expected)
            read += bool(expected)
    return read, {r.c for r in out if r.open and fb.literal_list(r.c)}


def test_cells(spark):
    read, missed = _compare(spark, CELLS)
    assert read == sum(bool(fb.literal_list(c)) for c in CELLS) - len(missed)
    # the spellings that the docstring leaves out, and no others
    assert missed == {
        r"['\N{BULLET}']", "[2.5, 2.50, 0.0, -0.0, +1.250, 0.0001, 0.00001]", "[123456789.123456, 1234567890.5]", "[1e5]", "[.5]", "[1.]", "[1_000]",
        "[0x1F]", "['a' 'b']", "['''a''']", "[r'\\n']", "['a', # c\n'b']",
    }


def test_random_texts(spark):
    draw = random.Random(11)
    parts = ["[", "]", "(", ")", ",", ", ", "'", '"', "\\", "a", "b c", "é", "0", "7", "1.5", "-", "None", "True", "\\x41", "\\u00e9", "\\n", "\n", " ", "u", "😀"]
    noise = ["".join(draw.choices(parts, k=draw.randrange(1, 12))) for _ in range(4000)]

    def scalar():
        text = "".join(draw.choices(parts, k=draw.randrange(6)))
        return draw.choice([repr(text), repr(text).replace("é", "\\xe9"), str(draw.randrange(-99, 99)), f"{draw.uniform(-9, 9):.4f}", "None", "False"])

    lists = [
        draw.choice(["[%s]", "(%s)", "[%s,]", "(%s,)", "%s,", " [%s] "]) % draw.choice([", ", ",", " ,\t"]).join(scalar() for _ in range(draw.randrange(1, 6)))
        for _ in range(4000)
    ]
    _compare(spark, noise)
    read, missed = _compare(spark, lists)
    assert read > 3000 and not missed


def test_long_cells(spark):
    cells = ["[" + r"'it\'s', " * 50_000 + "]", "['" + r"\\" * 200_000 + "',]", "['" + "x" * 2_000_000 + "',]", "(" * 100_000, "['a', " * 50_000]
    assert _compare(spark, cells)[0] == 3


def test_no_python_in_the_plan(spark):
    odd = spark.createDataFrame([(i, c) for i, c in enumerate(fx.ODD_LISTS)], "i int, c string")
    out = odd.select("i", fb.parse_brands("c", exact="jvm").alias("l"), fb.is_undecided(F.col("c")).alias("open"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    got = {r.i: r.l for r in out.collect()}
    assert got == {i: fb.literal_list(c) for i, c in enumerate(fx.ODD_LISTS)}
