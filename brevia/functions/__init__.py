"""Part of brevia."""
