"""Bindings onto the test tables and the registered queries."""
