"""Column-expression building blocks (all JVM-side Catalyst expressions)."""

from seqlake.functions.keys import hash_key, uniform01, xxhash_key
from seqlake.functions.text import join_ws, split_ws

__all__ = ["hash_key", "uniform01", "xxhash_key", "split_ws", "join_ws"]
