"""Queries over the driver's tables."""


def load_all() -> None:
    """Import every module that registers queries."""
    from tickloom.workload import io_queries, market_queries, model_queries, stream_queries, table_queries, training_queries  # noqa: F401
