"""railpulse.plans."""
