"""All queries over the relational tables, with the SQL that states each."""

from . import extensions, mining, relational, resampling, robust, statistics

QUERIES = relational.QUERIES | statistics.QUERIES | mining.QUERIES | robust.QUERIES | resampling.QUERIES | extensions.QUERIES
ORACLE_SQL = relational.ORACLE_SQL | statistics.ORACLE_SQL | mining.ORACLE_SQL | robust.ORACLE_SQL | resampling.ORACLE_SQL | extensions.ORACLE_SQL
