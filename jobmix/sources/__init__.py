"""Input tables: catalog / parquet loaders and test-fixture derivation."""

from jobmix.sources.tables import SYSTEM_TABLES, Tables

__all__ = ["SYSTEM_TABLES", "Tables"]
