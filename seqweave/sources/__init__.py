"""Scans and sinks: sequence text, feature matrices, predictions, manifests, structures, and the demo tables."""
