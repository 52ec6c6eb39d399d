"""Tidemark: a Spark-native engine for disclosure analytics and corpus preparation."""
