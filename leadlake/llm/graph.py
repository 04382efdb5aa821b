"""Connected components, as the whole library takes them."""

from leadlake.functions.components import components

__all__ = ["components"]
