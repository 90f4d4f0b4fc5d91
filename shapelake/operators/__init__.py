"""Relational operators over points, meshes, grids and fields."""
