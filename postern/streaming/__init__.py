"""Event intake: parsing, dedup, current state, minute buckets, trailing counts, and their streams."""
