"""Operators for text and record corpora; nothing outside this subpackage imports it."""
