"""Part of the roughness analytics engine."""
