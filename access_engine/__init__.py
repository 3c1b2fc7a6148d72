"""Accessibility and catchment analytics as Spark jobs over raster cells."""
