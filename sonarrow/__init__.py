"""Spark-native operators for sampled signals, transcripts and text."""
