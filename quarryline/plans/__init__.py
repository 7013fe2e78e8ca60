"""The control plane: contracts, their loading and reconciliation, and the sink that carries out a write."""
