"""A PySpark-native engine for ordered key-value data.

One logical table type, the operation log of puts and deletes, folds to the latest live
value of each key.  Lookups, ordered scans, sorted runs, block metadata, interval joins,
delta algebra, snapshots and streaming ingest are DataFrame functions on top of it.
"""
