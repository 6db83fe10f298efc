"""Registration of queries with their oracles."""


def registry():
    """A decorator that registers a query with its SQL, and the two tables it fills."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return query, queries, oracles
