"""DataFrame operators: document metrics, feature assembly, profiling, labels, experiments."""
