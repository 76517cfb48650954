"""tessera: document analytics, sync planning and vector retrieval as Spark DataFrame jobs."""
