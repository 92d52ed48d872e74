"""Spark-native analytics over grids, vector features, time stacks and meshes."""
