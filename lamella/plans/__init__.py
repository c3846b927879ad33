"""The engine's queries."""
