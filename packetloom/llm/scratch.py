"""Tables written in the folder that all executors share, as for the rest of the library."""

from packetloom.scratch import new_path, shared_dir, stage

__all__ = ["new_path", "shared_dir", "stage"]
