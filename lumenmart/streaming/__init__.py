"""streaming of the market analytics package."""
