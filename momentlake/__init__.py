"""Moments in very large collections of timed transcripts and live streams, on Spark."""
