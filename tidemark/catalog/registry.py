"""The table of registered queries: a Spark callable and, where SQL can say the same thing, its oracle."""
from tidemark.catalog.oracle_views import with_views
from tidemark.runtime import pin_session

QUERIES = {}
ORACLES = {}


def query(name, sql=None, views=()):
    """Register `fn(spark, sf_dir)`; `sql` is the body of the oracle over the named derived views."""
    def register(fn):
        if name in QUERIES:
            raise ValueError("query registered twice: " + name)

        def run(spark, sf_dir):
            return fn(pin_session(spark), str(sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn
    return register
