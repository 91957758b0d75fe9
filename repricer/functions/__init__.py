"""Column functions: they only build expressions, so batch and stream share them."""
