"""sources of the market analytics package."""
