"""Readers and writers of stores, bundles, manifests and documents."""
