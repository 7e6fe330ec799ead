"""All registered queries and their SQL."""

from docloom.plans import queries, wider

QUERIES = queries.QUERIES | wider.QUERIES
SQL = queries.SQL | wider.SQL
