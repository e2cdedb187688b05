"""All registered queries."""

from __future__ import annotations

from fleetscope.plans import (
    change_queries,
    counter_queries,
    fleet_queries,
    replication_queries,
    slowlog_queries,
    space_queries,
    text_queries,
)
from fleetscope.plans.registry import Entry

ENTRIES: dict[str, Entry] = {
    **counter_queries.ENTRIES, **text_queries.ENTRIES, **slowlog_queries.ENTRIES, **space_queries.ENTRIES,
    **change_queries.ENTRIES, **replication_queries.ENTRIES, **fleet_queries.ENTRIES,
}
