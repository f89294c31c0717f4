"""Grammars and lexers of JSON and Python; those of Ruby and ERB are shared with the front ends."""
