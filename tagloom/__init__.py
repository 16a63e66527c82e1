"""Spark-native sequence labelling, and operators for training-data pipelines."""
