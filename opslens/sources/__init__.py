"""Readers: raw tables, logical snapshot tables derived from them, text lines."""

from opslens.sources.fixtures import Snapshot  # noqa: F401
from opslens.sources.tables import read_table  # noqa: F401
