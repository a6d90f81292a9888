"""A PySpark-native engine for page assets, catalogues and text corpora."""
