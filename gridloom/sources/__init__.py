"""Readers and sinks: raster headers and samples, manifests, archives, reports."""
