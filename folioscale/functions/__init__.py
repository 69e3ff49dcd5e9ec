"""Part of folioscale."""
