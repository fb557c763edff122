"""DataFrame transformations: tables, chunking, layout, structure, retrieval, answers."""
