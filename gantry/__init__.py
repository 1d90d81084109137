"""Gantry: DataFrame operators for training telemetry, configuration studies and corpus work."""
