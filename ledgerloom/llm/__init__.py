"""Training-data operators: quality, toxicity, mixing, packing, joins, sharding, token files."""
