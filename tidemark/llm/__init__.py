"""Training-data operators: each module has one operator; ``registry`` names their queries."""
