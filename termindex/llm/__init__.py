"""Training-data operators: deduplication, filters, decontamination, packing, formatting, sharding."""
