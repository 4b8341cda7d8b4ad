"""Recurrent and attention sequence models in NumPy, applied to batches of rows."""
