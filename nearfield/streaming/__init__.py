"""Stateful streams: health of search cores from their snapshots."""
