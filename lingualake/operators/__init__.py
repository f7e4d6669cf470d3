"""Operators over unit and segment tables: compiling, synchronising, translating, validating."""
