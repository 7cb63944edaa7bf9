"""keystrata: a Spark-native engine for keyed, versioned mutation logs."""

from keystrata.model import LOG_SCHEMA, Options, Paths
from keystrata.store import Store

__all__ = ["LOG_SCHEMA", "Options", "Paths", "Store"]
