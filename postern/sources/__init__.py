"""Declared states, the tables that hold them, and namespaces that bring both together."""
