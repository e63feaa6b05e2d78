"""Training-data operators: near-duplicate search, quality, language, scoring, mixing, fingerprints, personal data, token files."""
