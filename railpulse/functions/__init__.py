"""railpulse.functions."""
