"""DataFrame-to-DataFrame operators over panels, keys, features and graphs."""
