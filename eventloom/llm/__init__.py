"""Training-data operators: scans, joins, packing, mixing, filters, counts, extraction, sharding."""
