"""Registered queries over the driver's tables, with SQL of the same meaning."""
