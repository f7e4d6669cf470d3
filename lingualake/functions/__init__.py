"""Column functions that the sources and operators share."""
