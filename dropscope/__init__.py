"""Network-threat analytics as PySpark DataFrame jobs."""

from dropscope.config import Config

__all__ = ["Config"]
