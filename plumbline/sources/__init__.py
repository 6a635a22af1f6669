"""Files in and out: JSON Lines with validation, ledgers that are only appended to, published folders, a registry of sources."""
