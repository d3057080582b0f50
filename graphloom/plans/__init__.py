"""The query front end: text to DataFrame plans, and updates to new graphs."""

from .query import run_query
from .update import execute, run_update

__all__ = ["execute", "run_query", "run_update"]
