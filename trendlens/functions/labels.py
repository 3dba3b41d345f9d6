"""Topic labels for keywords.

Two different rules, kept apart on purpose:

* mapped: a keyword that found a topic through the category map keeps it; else
  ``level1 > level2`` where a null ``level1`` makes the whole label null (so the
  row leaves per-topic sums) and a null ``level2`` reads as empty text.
* fallback (no map at all): both levels read as empty text, and the bare
  separator becomes ``Uncategorized``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendlens.functions._util import as_col

# Separator and the label for an empty category pair.
SEPARATOR = " > "
UNCATEGORIZED = "Uncategorized"


def mapped_label(topic: Column | str, level1: Column | str, level2: Column | str) -> Column:
    """``coalesce(topic, level1 || ' > ' || coalesce(level2, ''))``, then ``'' -> Uncategorized``."""
    label = F.coalesce(
        as_col(topic),
        F.concat(as_col(level1), F.lit(SEPARATOR), F.coalesce(as_col(level2), F.lit(""))),
    )
    return F.when(label == "", F.lit(UNCATEGORIZED)).otherwise(label)


def fallback_label(level1: Column | str, level2: Column | str) -> Column:
    """``coalesce(level1,'') || ' > ' || coalesce(level2,'')``, then ``' > ' -> Uncategorized``."""
    label = F.concat(
        F.coalesce(as_col(level1), F.lit("")), F.lit(SEPARATOR), F.coalesce(as_col(level2), F.lit(""))
    )
    return F.when(label == SEPARATOR, F.lit(UNCATEGORIZED)).otherwise(label)
