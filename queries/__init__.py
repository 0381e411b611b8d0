"""Registered queries: each with the Spark callable and, where SQL can say it, its DuckDB twin."""

from queries import catalogs, checks, cleaning, landing, profiling, repairs, sketches, streams

ALL = {**profiling.QUERIES, **cleaning.QUERIES, **checks.QUERIES, **catalogs.QUERIES, **landing.QUERIES, **repairs.QUERIES, **sketches.QUERIES, **streams.QUERIES}
