"""Where the query modules enter their queries and oracles."""

from pyspark.sql import functions as F

from workload.tables import POSTINGS_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, postings: bool = True):
    """Register a query; `sql` may read the flat postings `p` if `postings`."""
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = _with_postings(sql) if postings else sql
        return function
    return register


def _with_postings(sql: str) -> str:
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {POSTINGS_SQL},\n{body[5:]}"
    return f"WITH {POSTINGS_SQL}\n{body}"


def r(c, digits: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
