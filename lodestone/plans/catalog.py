"""All registered queries of the library: name to (plan builder, DuckDB SQL or None)."""

from __future__ import annotations

from . import capturing, indexing, logs, noting, relational, retrieval, reviewing

QUERIES = {**retrieval.QUERIES, **capturing.QUERIES, **indexing.QUERIES, **logs.QUERIES, **noting.QUERIES, **reviewing.QUERIES, **relational.QUERIES}
