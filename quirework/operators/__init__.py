"""operators of quirework."""
