"""Spark-native sequencing quality control for DNA data storage."""
