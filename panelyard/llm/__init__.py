"""Training-data operators on Spark: token counts, HTML text, decontamination, quality rules,
toxicity, WARC archives, exact-substring and near-duplicate removal, and sequence packing."""
