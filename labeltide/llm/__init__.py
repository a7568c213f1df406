"""Training-data operators: quality, web archives, decontamination, near-duplicates, token files, mixing, sharding, secrets and personal data."""
