"""Shared by the test modules (a module of its own: every folder may have a conftest)."""


def rows(df, *cols):
    """Collect to a dict keyed by the first column(s) for easy asserts."""
    out = {}
    for r in df.collect():
        d = r.asDict()
        key = tuple(d[c] for c in cols) if len(cols) > 1 else d[cols[0]]
        out[key] = d
    return out
