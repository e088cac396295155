"""Readers, writers, configurations and registries."""
