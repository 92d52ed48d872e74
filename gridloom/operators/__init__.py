"""Operators over rasters, cubes, features and meshes."""
