"""DataFrame operators over (track_id, frame) tables."""
