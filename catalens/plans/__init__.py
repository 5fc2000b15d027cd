"""Pipelines: laptop features, movie facets and recommendations, price models."""
