"""Part of gaugeworks."""
