"""Training-data operators: token packing, scoring, decontamination, media, labels, dedup."""
