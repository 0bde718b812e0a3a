"""Plan-level helpers: session defaults, lineage cuts, block sizes."""

from peerlens.plans.lineage import new_folder, release, shared_folder, shuffle_partitions, stage

__all__ = ["new_folder", "release", "shared_folder", "shuffle_partitions", "stage"]
