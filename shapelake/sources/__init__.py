"""Readers and writers of landmarks, meshes, images and models."""
