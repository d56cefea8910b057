"""Operators on scans, poses and voxel maps, as DataFrame transformations."""
