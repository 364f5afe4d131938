"""Writing results so that readers see all of them or nothing."""
