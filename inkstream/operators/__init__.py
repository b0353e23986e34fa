"""DataFrame operators: storing, merging, grouping in runs, looking up, linking and searching."""
