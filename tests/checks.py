"""Comparison of query results between engines."""


def plain(rows):
    """Rows as sorted tuples, floats rounded, so that both engines' values compare."""

    def one(x):
        if x is None or x != x:
            return None
        if isinstance(x, bool) or isinstance(x, str):
            return x
        return round(float(x), 6) if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


def agree(df, con, sql):
    names = sorted(df.columns)
    got = plain(tuple(r) for r in df.select([f"`{n}`" for n in names]).collect())
    cur = con.execute(sql)
    have = [x[0] for x in cur.description]
    assert sorted(have) == names
    at = [have.index(n) for n in names]
    assert got == plain(tuple(r[i] for i in at) for r in cur.fetchall())
