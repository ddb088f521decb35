"""Operators for training data: tokens, fingerprints, labels, extraction, near duplicates, filters, packing, privacy."""
