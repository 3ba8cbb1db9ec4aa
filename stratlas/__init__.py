"""Atlas analytics on Spark: hierarchies, voxel maps, locations and anchored measurements as DataFrames."""
