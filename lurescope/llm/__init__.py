"""Training-data operators: one module per operator, each with its own general
interface, plus ``queries.py`` (the thin registered queries and their SQL)."""
