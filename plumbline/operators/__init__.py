"""DataFrame operators: classification, selection, roll-ups, scores, findings."""
