"""Stages and whole pipelines."""
