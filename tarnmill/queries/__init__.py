"""The engine's operators applied to the driver's tables, with the same results in plain SQL."""
