"""Package part; see the README for the map."""
