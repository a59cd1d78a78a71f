"""Spark jobs that turn raw text items into ranked, explainable leads."""
