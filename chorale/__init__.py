"""Spark-native analytics for sharded message archives: association, selection, curation, export and retention."""
