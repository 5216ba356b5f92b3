"""Column expressions: text patterns, calendar, tiers and scores."""
