"""Where tables come from: data sets by name and synthetic series."""
