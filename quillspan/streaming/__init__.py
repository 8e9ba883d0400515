"""The batch operators over a growing folder of sources."""
