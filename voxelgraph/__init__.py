"""voxelgraph: Spark-native analytics over labelled 3-D volumes held as tables."""
