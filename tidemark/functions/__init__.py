"""Column expressions: text, names, URLs, dates, rules and scores."""
