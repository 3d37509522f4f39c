"""tickloom: order-book and trade-tick analytics as Spark DataFrame operators."""

NS_PER_MS = 1_000_000
NS_PER_SECOND = 1_000_000_000

__all__ = ["NS_PER_MS", "NS_PER_SECOND"]
