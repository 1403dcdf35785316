"""Readers, the named-dataset catalogue and column profiling."""

from custlens.sources.io import Catalog, preview, read_table, shape
from custlens.sources.profiling import profile, roles

__all__ = ["Catalog", "preview", "read_table", "shape", "profile", "roles"]
