"""Analytics over ordered text steps."""
