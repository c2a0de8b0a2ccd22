"""railpulse.operators."""
