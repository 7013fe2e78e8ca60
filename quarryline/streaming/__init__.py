"""Batched and streamed writes, and sensors over the period registry."""
