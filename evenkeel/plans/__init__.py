"""Cuts, rings and partitioners."""
