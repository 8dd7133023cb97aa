"""The queries of the engine's own operators; importing the package registers them all."""

from . import campaigns, dashboard, decisions, indexes, jobs, language, periods, policies, records, search, texts

__all__ = ["campaigns", "dashboard", "decisions", "indexes", "jobs", "language", "periods", "policies", "records", "search", "texts"]
