"""Reading and writing the three input tables, and adapters from the driver tables."""

from trustlens.sources.fixtures import PROFILES, Profile, load_profile
from trustlens.sources.tables import append_tables, is_empty, read_tables, write_tables

__all__ = ["PROFILES", "Profile", "load_profile", "read_tables", "write_tables", "append_tables", "is_empty"]
