"""Queries over the given tables."""


def register_all() -> None:
    """Import the modules that register queries."""
    from windrow.plans import (  # noqa: F401
        ingest_queries,
        learning,
        operating_points,
        reports,
        signal_features,
        sources_labels,
        splits_ledger,
        stored_queries,
        windows_events,
    )
