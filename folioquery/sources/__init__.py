"""Where pages come from and where indexes are kept."""
