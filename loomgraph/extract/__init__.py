"""Extractors: code structure without a model, prose with one."""
