"""Named queries and their DuckDB equivalents."""

from __future__ import annotations

from ledgerlake.config import EngineConfig
from ledgerlake.plans import analytics, versioned
from ledgerlake.sources.tables import with_views


#: Analytical queries that are registered at epochs of the change logs too, and those epochs.
AT_EPOCHS = ("q01", "q06", "q12", "q18"), (10, 20)


def _on_folder(query, as_of=None):
    def run(spark, sf_dir):
        return query(spark, EngineConfig(sf_dir, as_of=as_of))

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _plans in (analytics, versioned):
    QUERIES |= {name: _on_folder(query) for name, query in _plans.QUERIES.items()}
    ORACLE_SQL |= {name: with_views(sql) for name, sql in _plans.SQL.items()}
for _name in AT_EPOCHS[0]:
    for _epoch in AT_EPOCHS[1]:
        QUERIES[f"{_name}_asof{_epoch}"] = _on_folder(analytics.QUERIES[_name], _epoch)
        ORACLE_SQL[f"{_name}_asof{_epoch}"] = with_views(analytics.SQL[_name], _epoch)
