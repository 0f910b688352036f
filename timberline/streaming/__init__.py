from .ingest import ingest

__all__ = ["ingest"]
