"""All registered queries outside the text-corpus subpackage, with their DuckDB SQL."""

from traceaudit.plans.base import ORACLE_SQL, QUERIES
from traceaudit.plans import claims, files, joins, outcomes, samples, scores, stats, streams, tasks, text, tokens, variants  # noqa: F401  each registers its queries

__all__ = ["ORACLE_SQL", "QUERIES"]
