"""All registered panel queries and their SQL oracles."""

from panelith.queries import access, evaluation, factors

QUERIES = {**factors.QUERIES, **evaluation.QUERIES, **access.QUERIES}
ORACLE_SQL = {**factors.ORACLE_SQL, **evaluation.ORACLE_SQL, **access.ORACLE_SQL}
