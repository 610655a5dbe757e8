"""Operators by family: events, state, schema, quality, dead letters, metrics, BI."""
