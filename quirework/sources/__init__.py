"""sources of quirework."""
