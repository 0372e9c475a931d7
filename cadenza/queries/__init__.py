"""One query for each operator over the driver's tables or over literal fixtures, with DuckDB SQL for its rows where SQL can express it."""

from . import composed, dictionary, folds, joins, large, recordings, reports, signals, spoken, texts

QUERIES = texts.QUERIES | signals.QUERIES | dictionary.QUERIES | reports.QUERIES | joins.QUERIES | folds.QUERIES | composed.QUERIES | large.QUERIES | spoken.QUERIES | recordings.QUERIES
ORACLE_SQL = texts.ORACLE_SQL | signals.ORACLE_SQL | dictionary.ORACLE_SQL | reports.ORACLE_SQL | joins.ORACLE_SQL | folds.ORACLE_SQL | composed.ORACLE_SQL | large.ORACLE_SQL | spoken.ORACLE_SQL | recordings.ORACLE_SQL
