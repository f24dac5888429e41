"""skein: a PySpark-native analytics library for conversations, token sequences and event logs."""
