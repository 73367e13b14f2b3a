"""Training-data operators: license scan, packing, similarity join, token files,
decontamination, toxicity, quality, sharding, line dedup, token counts."""
