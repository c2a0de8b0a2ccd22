"""railpulse.streaming."""
