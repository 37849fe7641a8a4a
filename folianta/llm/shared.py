"""Tables in the folder that the cluster shares."""

from __future__ import annotations

from ..tables import Tables, cut, small, stored

__all__ = ["Tables", "cut", "small", "stored"]
