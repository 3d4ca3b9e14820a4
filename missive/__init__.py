"""Missive: a PySpark-native engine for personal communication archives."""
