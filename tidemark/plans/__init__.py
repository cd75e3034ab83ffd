"""Multi-step jobs: generation, refresh, audit and governance."""
