"""DataFrame operators: storage algebra, frontier, rolling statistics, keyword sets."""
