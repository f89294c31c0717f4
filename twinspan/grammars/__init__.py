"""Grammars that front ends read source texts by, a table generator for them, and the lexers that feed the tables."""
