"""loam: a corpus builder and lexical retrieval engine expressed as Spark jobs."""
