"""Column expressions: text, dates, JSON, identifiers, types, tax brackets."""
