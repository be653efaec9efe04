"""Named queries over the test tables, with their SQL where SQL can say them."""
