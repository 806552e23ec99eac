"""Whole jobs: the batch average and the over-voltage prediction."""
