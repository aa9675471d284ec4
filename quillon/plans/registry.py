"""All queries over the reference's operators, and their SQL."""

from __future__ import annotations

from quillon.plans import answers, dialogue, editing, search, telemetry, text

QUERIES = {**telemetry.QUERIES, **text.QUERIES, **answers.QUERIES, **dialogue.QUERIES, **search.QUERIES, **editing.QUERIES}
SQL = {**telemetry.SQL, **text.SQL, **answers.SQL, **dialogue.SQL, **search.SQL, **editing.SQL}
