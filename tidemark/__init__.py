"""A Spark-native engine for keyed tables: lookups, snapshots, transactions and operation streams."""
