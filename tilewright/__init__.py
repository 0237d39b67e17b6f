"""tilewright: a PySpark-native engine for gigapixel-image catalogues."""
