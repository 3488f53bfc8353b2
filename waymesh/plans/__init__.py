"""Queries; importing the package registers them all."""

from . import perception, sensing, tracks  # noqa: F401
