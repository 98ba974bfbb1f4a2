"""Reports, validation checks, statistical analyses and the consolidated metric table."""
