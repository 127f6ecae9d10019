"""Plans over the decoded tables."""
