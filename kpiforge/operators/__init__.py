"""Analytics operators.  Each returns a lazy DataFrame."""
