"""What tests share."""


def rows(df, *columns):
    """The rows as tuples, sorted."""
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))
