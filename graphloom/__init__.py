"""graphloom: document streams, knowledge-graph tables and retrieval as Spark jobs."""
