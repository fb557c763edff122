"""docloom: a Spark-native engine for document retrieval analytics.

``sources`` reads and writes (files, archives, point and chat tables), ``functions`` are Column expressions,
``operators`` are DataFrame transformations, ``plans`` are the composed pipelines and the registered queries, and
``streaming`` feeds the same plans from file streams.
"""
