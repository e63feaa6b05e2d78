"""Spark-native analytics for ordered visual-state sequences and the datasets around them."""
