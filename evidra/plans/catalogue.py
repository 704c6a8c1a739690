"""Registered queries and the SQL each is held against."""

from __future__ import annotations

from evidra.plans import axes, content, files, finding, names, parts, ranking, reads, relations, reports, tasks

QUERIES: dict = {**ranking.QUERIES, **content.QUERIES, **relations.QUERIES, **reads.QUERIES, **names.QUERIES, **files.QUERIES, **finding.QUERIES, **parts.QUERIES, **axes.QUERIES, **tasks.QUERIES, **reports.QUERIES}
SQL: dict[str, str] = {**ranking.SQL, **content.SQL, **relations.SQL, **reads.SQL, **names.SQL, **files.SQL, **parts.SQL, **axes.SQL, **tasks.SQL, **reports.SQL}
