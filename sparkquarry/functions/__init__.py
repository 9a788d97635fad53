"""Column functions that rules and queries share."""
