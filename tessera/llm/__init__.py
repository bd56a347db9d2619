"""Training-data operators: sharding, decontamination, packing, scans and near-duplicates."""
