"""Training-data operators: chat formatting, packing, toxicity, media columns, license
scans, WARC archives, source mixing, similarity join, quality rules, page extraction."""
