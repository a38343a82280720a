"""Graph and cluster algorithms: iterative plans over node and edge tables."""
