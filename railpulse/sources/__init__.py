"""railpulse.sources."""
