"""Whole jobs: mask files by policy, detect and mask, and the volume table."""
