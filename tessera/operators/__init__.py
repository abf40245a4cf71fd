"""Operators on relations of sprites, layouts, markers, animations and rasters."""
