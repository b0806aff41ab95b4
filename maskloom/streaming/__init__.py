"""Masking of streams. Masking keeps no state, so any trigger and any restart are safe."""
