"""Readers and writers of evidence inputs."""
