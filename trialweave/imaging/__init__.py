"""Operators on the voxel table (image_name, z, y, x, value, mask)."""
