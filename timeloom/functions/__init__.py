"""Part of timeloom."""
