"""Spark-native table operators for spatial label and LiDAR analytics."""
