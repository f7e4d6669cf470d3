"""Localisation corpora as Spark tables: parsing, translating, compiling and synchronising files in bulk."""
