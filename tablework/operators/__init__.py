"""DataFrame operators: filters, renames, joins, groups, ranks, generation."""
