"""Training-data operators: archives, media, packing, deduplication, scans, quality, tokens and chat."""
