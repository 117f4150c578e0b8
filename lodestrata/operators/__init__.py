"""All operators; importing this registers them."""

from . import attribute, classify, geometry, importers, network, quality, raster, spatial, stats  # noqa: F401
from .registry import OPERATORS, NotSupported, apply

__all__ = ["OPERATORS", "NotSupported", "apply"]
