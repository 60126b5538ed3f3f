"""Every registered query and its check SQL."""

from . import edition_queries, item_queries, job_queries, reader_queries, runlog_queries

_PARTS = [item_queries, edition_queries, runlog_queries, reader_queries, job_queries]

QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
