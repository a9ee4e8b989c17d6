"""loomtrace: search, read, trace and curate append-only, tree-shaped event logs with Spark."""

from .session import checkpointed, get_session
from .tables import Tables

__all__ = ["Tables", "checkpointed", "get_session"]
