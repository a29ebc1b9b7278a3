"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

from chromafold.sources.lineage import hold, shared_dir, written

__all__ = ["hold", "shared_dir", "written"]
