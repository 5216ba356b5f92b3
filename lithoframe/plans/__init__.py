"""Query specifications, join planning and the SQL guard."""
