"""All registered queries."""

from trailmark.plans import alert_book, media_book, score_book, spread_book, stream_book  # noqa: F401
from trailmark.plans.book import ORACLE as RAW_SQL
from trailmark.plans.book import QUERIES
from trailmark.plans.oracle_views import expand

# the books share sub-queries, so they are put in only when all books are loaded
ORACLE = {name: expand(sql) for name, sql in RAW_SQL.items()}

__all__ = ["ORACLE", "QUERIES"]
