"""Tables that cut lineage, as the library keeps them."""

from ..scratch import Scratch, shared_folder, shuffle_partitions

__all__ = ["Scratch", "shared_folder", "shuffle_partitions"]
