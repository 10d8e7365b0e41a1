"""functions of the market analytics package."""
