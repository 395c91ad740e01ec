"""graphloom: document-graph retrieval and corpus preparation expressed as Spark jobs."""
