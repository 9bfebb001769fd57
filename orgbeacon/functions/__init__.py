"""Part of orgbeacon."""
