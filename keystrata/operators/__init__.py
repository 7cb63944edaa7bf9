"""DataFrame operators over mutation logs, runs and manifests."""
