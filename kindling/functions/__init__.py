"""Column functions for text, character sets and vectors."""
