"""docketry: document retrieval, review and analytics pipelines on Spark."""
