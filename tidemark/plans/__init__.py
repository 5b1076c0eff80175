"""The mart: silver roll-ups, the gold profile, checks, reports and runs."""
