"""The registered queries and the SQL each must agree with."""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL if there is one."""

    def add(fn):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
            return fn(spark, str(sf_dir).rstrip("/"))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
