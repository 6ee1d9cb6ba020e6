"""Streams: windows over events, and the progress of hosts."""
