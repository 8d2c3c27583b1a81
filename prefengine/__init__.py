"""prefengine: preference-data pipelines as Spark DataFrame / SQL / Structured Streaming jobs."""

from prefengine.session import get_session, shared_dir, require_columns

__all__ = ["get_session", "shared_dir", "require_columns"]
