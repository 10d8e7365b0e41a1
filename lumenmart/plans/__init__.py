"""plans of the market analytics package."""
