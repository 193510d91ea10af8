"""Rows of a table and of SQL in a form that can be compared."""


def rows(df):
    """Rows as sorted tuples, floats rounded, columns by name."""
    names = sorted(df.columns)
    return sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(duck, sql):
    t = duck.execute(sql).to_arrow_table()
    names = sorted(t.column_names)
    return sorted((tuple(_plain(r[n]) for n in names) for r in t.to_pylist()), key=repr)


def _plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0 if x == x else "nan"
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    if isinstance(x, dict):
        return tuple((k, _plain(v)) for k, v in sorted(x.items()))
    return x
