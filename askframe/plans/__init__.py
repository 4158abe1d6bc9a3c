"""Whole flows composed from operators; each stays one lazy plan where it can."""
