"""Column expressions: vocabularies, text, dates, statistics."""
