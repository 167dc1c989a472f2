"""Spark-first analytics over noisy transactional documents."""
