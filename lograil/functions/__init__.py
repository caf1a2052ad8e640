"""Column functions: times, decoding, text."""
