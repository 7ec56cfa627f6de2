"""Operators of the engine; each module holds one family."""
