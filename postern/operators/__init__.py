"""Queries and their terminals, continuation tokens, hydration, layout and administration."""
