"""scanframe: a PySpark-native engine for scan-level feature tables and voxel volumes."""

__version__ = "0.1.0"
