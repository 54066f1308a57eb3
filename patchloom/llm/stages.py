"""Written stages and checked broadcasts, as the whole library has them."""

from ..stages import BROADCAST_BYTES, keep, kept_bytes, light, shared_folder

__all__ = ["BROADCAST_BYTES", "keep", "kept_bytes", "light", "shared_folder"]
