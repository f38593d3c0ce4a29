"""Training-data operators: decontamination, extraction, quality, tokens, media, language, packing, WARC, dedup."""
