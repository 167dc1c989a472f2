"""Reliable lineage cuts, as the engine has them."""

from tallyweave.operators.kept import kept as cut

__all__ = ["cut"]
