"""What several test modules use; not in conftest.py, whose module name each test folder has."""

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


def rows(df, *cols):
    """Collected rows as plain tuples, sorted, for order-free comparison."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
