"""Relational operators over examples, grammars and predictions."""
