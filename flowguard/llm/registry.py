"""Where the query modules of this subpackage register themselves."""

QUERIES: dict = {}
ORACLE: dict = {}


def query(key: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame under a key."""
    def wrap(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return wrap
