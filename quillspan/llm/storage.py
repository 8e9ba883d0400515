"""Intermediate tables in the folder that all executors share, as the rest of the library keeps them."""

from quillspan.sources.scratch import cut, new_path, remove, shared_dir, small_batches

__all__ = ["cut", "new_path", "remove", "shared_dir", "small_batches"]
