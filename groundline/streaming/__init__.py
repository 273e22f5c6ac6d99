"""The same measures over pixels that keep arriving."""
