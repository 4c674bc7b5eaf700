"""Training-data operators: quality, secrets, fingerprints, packing, surrogates, WARC, language, sharding, BPE, near-dedup."""
