"""Palimpsest: a PySpark-native analytics engine over append-only, versioned documents."""
