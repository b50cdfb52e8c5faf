"""Training-data operators: extraction, filtering, de-duplication and tokens."""
