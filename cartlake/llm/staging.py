"""Intermediate tables in the folder that driver and executors share; see ``cartlake.sources.staging``."""

from cartlake.sources.staging import cut, freed, shared_folder, short_shuffles, small_batches, staged

__all__ = ["cut", "freed", "shared_folder", "short_shuffles", "small_batches", "staged"]
