"""Field points and raster observations to labelled objects and abundance, on Spark."""
