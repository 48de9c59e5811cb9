"""Spark-native multimodal time-series preparation and information decomposition."""
