"""Per-position sequence labelling on Spark: scans, splits, windows, motifs, scoring and ranking metrics."""
