"""Training-data operators: quality, deduplication, mixing, packing, search and scans."""
