"""Lamella: inspecting, selectively reading, re-encoding and writing columnar files with Spark."""
