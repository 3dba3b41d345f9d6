"""Brand-list text to ``array<string>``.

Cells hold the text of a Python list literal, e.g. ``['Acme', "Bob's"]``.  A
*plain* list (only quoted strings without backslashes or control characters)
is parsed JVM-side by ``from_json`` with single quotes allowed; on such text
that gives exactly the Python result.  Everything else that is not null goes,
when ``exact=True``, through an Arrow-batched pandas UDF that evaluates the
literal the way Python does; with ``exact=False`` it becomes an empty list and
the plan holds no Python node at all.

``exact="jvm"`` has no Python node either and reads *flat* lists and tuples as
Python does, by patterns and higher-order functions: strings in either quotes
with escapes, ``None``, ``True``, ``False``, decimal integers, and floats written
with a point and at most nine and six digits around it.  What is left are rarer
spellings (string prefixes but ``u``, triple quotes, strings put side by side,
``\\N{...}``, exponents, other bases, comments, items in parentheses).  They give
``[]`` there; :func:`is_undecided` finds the cells that may hold one.

Null, ``[]`` and unparsable text give ``[]``.  Elements that are ``None`` are
dropped; numbers and booleans become their text; a value that is not a list or
tuple of scalars gives ``[]``.
"""

from __future__ import annotations

import ast
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.functions._util import as_col

_SQ = r"'[^'\\\x00-\x1f]*+'"
_DQ = r'"[^"\\\x00-\x1f]*+"'
_ITEM = f"(?:{_SQ}|{_DQ})"
_WS = r"[ \t\n]*+"
# Java regular expression for a plain list literal (possessive repeats, so long
# lists do not backtrack).
PLAIN_LIST_PATTERN = rf"\A\[(?:{_WS}{_ITEM}{_WS}(?:,{_WS}{_ITEM}{_WS})*+)?\]\z"

# The flat literals.  Every repeat of a group is possessive, so the pattern
# neither backtracks nor recurses on long texts.
_HEX = "[0-9a-fA-F]"
_SURROGATE = "[dD][89a-fA-F]"
_ESCAPE = (
    rf"\\(?:[0-7]{{1,3}}+|x{_HEX}{{2}}|u(?!{_SURROGATE}){_HEX}{{4}}"
    rf"|U(?:0000(?!{_SURROGATE}){_HEX}{{4}}|000[1-9a-fA-F]{_HEX}{{4}}|0010{_HEX}{{4}})|[^xuUN0-7\r\x00])"
)
_STRINGS = [rf"{q}[^{q}\\\n\r\x00]*+(?:{_ESCAPE}[^{q}\\\n\r\x00]*+)*+{q}" for q in "'\""]
_FLOAT = r"[+-]?(?:[1-9][0-9]{0,8}|0(?!\.0{4,}[0-9]*[1-9]))\.[0-9]{1,6}+"
_INTEGER = r"[+-]?(?:0++|[1-9][0-9]{0,4000}+)"
_SCALAR = rf"(?:[uU]?(?:{_STRINGS[0]}|{_STRINGS[1]})|None|True|False|{_FLOAT}|{_INTEGER})"
_GAP = r"[ \t\n\r\f]*+"
_LIST = rf"\[{_GAP}(?:{_SCALAR}{_GAP}(?:,{_GAP}{_SCALAR}{_GAP})*+(?:,{_GAP})?)?\]"
_TUPLE = rf"\({_GAP}(?:{_SCALAR}{_GAP},{_GAP})++(?:{_SCALAR}{_GAP})?\)"
_BARE = rf"(?:{_SCALAR}[ \t]*+,[ \t]*+)++(?:{_SCALAR})?"
FLAT_PATTERN = rf"\A[ \t]*+(?:{_LIST}|{_TUPLE}|{_BARE})[ \t\n]*+\z"
_PIECE = rf"{_ESCAPE}|[^\\]++"

# Characters that a backslash and a letter stand for.
_LETTER_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\n": ""}

STRING_ARRAY = T.ArrayType(T.StringType())

# The UDF below travels to the Python workers by value, so executors need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def literal_list(text: str | None) -> list[str] | None:
    """Python-literal evaluation of one odd cell; ``None`` input stays ``None``."""
    if text is None:
        return None
    try:
        value = ast.literal_eval(text)
        if not isinstance(value, (list, tuple)):
            return []
        items = [item for item in value if item is not None]
        if not all(isinstance(item, (str, int, float, bool)) for item in items):
            return []
        out = [item if isinstance(item, str) else str(item) for item in items]
        for item in out:
            item.encode()  # a lone surrogate is no text that a column could hold
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return []
    return out


@F.pandas_udf(STRING_ARRAY)
def _literal_lists(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: literal_list(t) if isinstance(t, str) else None)


def is_plain_list(c: Column | str) -> Column:
    return as_col(c).rlike(PLAIN_LIST_PATTERN)


def could_be_sequence(c: Column | str) -> Column:
    """False where Python could not evaluate the text to a list or tuple.

    A list display needs ``[``, a tuple needs ``(`` or a comma; text with none
    of them evaluates (if at all) to a scalar, a set or a dict, all of which
    give ``[]`` here.  Such cells never need the Python path.
    """
    return as_col(c).rlike(r"[\[(,]")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _character(number: Column) -> Column:
    """The character of a code point in hexadecimal digits."""
    narrow = F.decode(F.unhex(F.lpad(number, 4, "0")), "UTF-16BE")
    return F.when(F.length(number) <= 4, narrow).otherwise(F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32"))


def _piece(p: Column) -> Column:
    """What one escape, or a text without any, stands for."""
    first = F.substring(p, 2, 1)
    number = F.when(first.isin("x", "u", "U"), F.conv(F.substring(p, 3, 8), 16, 16)).otherwise(F.conv(F.substring(p, 2, 3), 8, 16))
    known = F.when(first.rlike("[xuU0-7]"), _character(number))
    for letter, character in _LETTER_ESCAPES.items():
        known = known.when(first == letter, F.lit(character))
    quoted = F.when(first.isin("\\", "'", '"'), first)
    return F.when(F.substring(p, 1, 1) != "\\", p).otherwise(F.coalesce(known, quoted, p))


def _scalar_text(item: Column) -> Column:
    """Text of a scalar; null for ``None``."""
    body = F.regexp_extract(item, r"""(?s)\A[uU]?['"](.*)['"]\z""", 1)
    unescaped = F.when(F.contains(body, F.lit("\\")), F.array_join(F.transform(_all(body, _PIECE), _piece), "")).otherwise(body)
    unsigned = F.regexp_replace(F.regexp_replace(item, r"\A\+", ""), r"\A-?0+\z", "0")
    return (
        F.when(item.rlike(r"""\A[uU]?['"]"""), unescaped)
        .when(item != "None", F.regexp_replace(unsigned, r"(\.[0-9]+?)0+\z", "$1"))
    )


def flat_list(c: Column | str) -> Column:
    """Elements of a flat list or tuple; null for any other text."""
    text = as_col(c)
    items = F.transform(_all(text, _SCALAR), _scalar_text)
    return F.when(text.rlike(FLAT_PATTERN), F.filter(items, lambda x: x.isNotNull()))


def is_undecided(c: Column | str) -> Column:
    """Whether ``exact="jvm"`` may have missed a list: a text that could be a
    sequence, but not one that it reads.  Never null."""
    text = as_col(c)
    return F.coalesce(could_be_sequence(text) & ~is_plain_list(text) & ~text.rlike(FLAT_PATTERN), F.lit(False))


def parse_brands(c: Column | str, exact: bool | str = True) -> Column:
    text = as_col(c)
    plain = text.isNotNull() & is_plain_list(text)
    parsed = F.when(plain, F.from_json(text, STRING_ARRAY, {"allowSingleQuotes": "true"}))
    empty = F.array().cast(STRING_ARRAY)
    if exact == "jvm":
        return F.coalesce(parsed, flat_list(F.when(~plain, text)), empty)
    if not exact:
        return F.coalesce(parsed, empty)
    # The UDF sees null for all other cells: Spark evaluates a Python UDF for
    # every row, so only odd cells that may be sequences carry text across.
    odd = _literal_lists(F.when(text.isNotNull() & ~plain & could_be_sequence(text), text))
    return F.coalesce(parsed, odd, empty)
