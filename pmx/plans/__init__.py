"""Named queries: each module registers its plans with their oracles."""
