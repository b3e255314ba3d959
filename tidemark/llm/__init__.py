"""Operators for preparing training text. Nothing else in tidemark imports this subpackage."""
