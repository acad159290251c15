"""Training-data operators. Nothing else in brevia imports this subpackage."""
