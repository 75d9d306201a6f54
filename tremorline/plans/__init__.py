"""Batch jobs built from the sources and operators."""

from .prepare import deliver_ranges, prepare_microfiles, prepare_replay

__all__ = ["deliver_ranges", "prepare_microfiles", "prepare_replay"]
