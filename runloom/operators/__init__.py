"""DataFrame operators over experiments, runs, evaluations and files."""
