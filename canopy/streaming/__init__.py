"""Incremental runs. The batch operators have no streaming counterpart to match; what streams is the arrival of tiles."""
