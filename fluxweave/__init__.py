"""fluxweave: a PySpark-native engine for multichannel event analytics."""
