"""Stages that chain operators from source tables to delivered tables."""
