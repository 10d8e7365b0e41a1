"""operators of the market analytics package."""
