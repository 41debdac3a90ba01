"""Training-data operators: quality, deduplication, decontamination, mixing, packing, scoring."""
