"""Tessera: texture-atlas production and corpus preparation as Spark jobs."""
