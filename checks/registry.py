"""``@query`` registers a Spark callable and, where SQL can say it, the oracle."""

from checks.oracle_ctes import with_ctes

QUERIES = {}
ORACLES = {}


def query(name, sql=None, needs=()):
    """``needs`` names the shared common table expressions the oracle builds on."""

    def register(run):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(needs, sql)
        return run

    return register
