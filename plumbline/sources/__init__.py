"""Sources: tree discovery and table views that feed the operators."""
