"""Folders watched as streams."""
