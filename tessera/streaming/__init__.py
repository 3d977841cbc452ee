"""Streams. The analyses are batch jobs over finished tables; nothing here is stateful or needs watermarks."""
