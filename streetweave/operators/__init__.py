"""Operators on networks: building, preparing, snapping, distances, paths, metrics, service areas, batches."""
