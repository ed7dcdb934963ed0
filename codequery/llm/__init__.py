"""Training-data operators: licence scans, extraction, quality, dedup, mixing, archives, PII, search, tokens."""
