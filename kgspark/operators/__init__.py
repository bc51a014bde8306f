"""DataFrame operators: pages, resources, documents, extraction, concepts, relations, graph, retrieval."""
