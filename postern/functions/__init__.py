"""Typed values: codecs of indexed columns and the expressions that canonicalise them."""
