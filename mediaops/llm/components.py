"""Connected components of near copies: the library's star contraction."""

from mediaops.operators.graph import connected_components

__all__ = ["connected_components"]
