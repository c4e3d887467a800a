"""Tables written to the shared folder."""

from ..store import dropped, shared_dir, written

__all__ = ["dropped", "shared_dir", "written"]
