"""Part of the frame-ordering analytics engine."""
