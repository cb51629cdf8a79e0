"""Files of many formats as documents with spans and tables."""
