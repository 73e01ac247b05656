"""Reading, decoding, encoding and writing the record tables."""
